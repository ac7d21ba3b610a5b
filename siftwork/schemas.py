"""Row types of the engine and the domains of their enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _b = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


COMMENT = _struct(summary_line=_s, body_preview=_s, flags=T.ArrayType(_s), source=_s, normalization_status=_s)
EXPORT = _struct(publicness=_s, export_kind=_s, container=_s)
SYMBOLS = _struct(name=_s, kind=_s, filepath=_s, start_line=_i, end_line=_i, params=T.ArrayType(_s), signature_preview=_s, comment=COMMENT, export=EXPORT, ordinal=_i)
REEXPORTS = _struct(filepath=_s, start_line=_i, end_line=_i, local_name=_s, exported_name=_s, source_specifier=_s, is_type_only=_b, ordinal=_i)
DOC_SECTIONS = _struct(filepath=_s, section_title=_s, heading_hierarchy=T.ArrayType(_s), content=_s, code_symbols=T.ArrayType(_s), start_line=_i, end_line=_i, ordinal=_i)
POSTINGS = _struct(term=_s, doc_id=_l, field_id=T.ByteType(), tf=_i, dl=_i)
DOC_FREQS = _struct(term=_s, df=_l)
FIELD_STATS = _struct(field_id=T.ByteType(), total_length=_l, doc_count=_l)
DOC_STORE = _struct(doc_id=_l, doc_type=_s, filepath=_s, name=_s, kind=_s, start_line=_i, end_line=_i, is_example=_b, section=_s, snippet=_s)
MODULE_RULES = _struct(scope_dir=_s, base_url=_s, pattern=_s, targets=T.ArrayType(_s))

# The domains.
SYMBOL_KINDS = ("Function", "Method", "Class", "Struct", "Enum", "Interface", "Module", "Type", "Trait", "Const")
TYPE_KINDS = ("Class", "Struct", "Enum", "Interface", "Module", "Type", "Trait")
COMMENT_FLAGS = ("Deprecated", "Experimental", "Internal", "Unsafe")
COMMENT_SOURCES = ("JsDoc", "RustDoc", "PythonDocstring", "PlainComment")
PUBLICNESS = ("Public", "Reexported", "Package", "Private", "Unknown")
EXPORT_KINDS = ("Named", "Default", "Reexport", "ModuleMember", "None", "Unknown")
COVERAGE = ("Complete", "Partial", "Unsupported")
LINK_REASONS = ("TestPathMatch", "TestNameMatch", "FileStemMatch", "DirectoryProximity")
FIELD_WEIGHTS = (4.0, 2.0, 1.5, 1.0)  # name or title, comment or content, params or code symbols, path
MAX_FIELD_LENGTH = 65535
