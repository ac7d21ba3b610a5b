"""Symbols and re-exports of a parsed file, as the scanner reports them.

Visibility follows each language's rule: Rust by pub, Python, Go and Ruby by a leading
underscore, Java by its modifiers, C by static, TypeScript by export.  Comments are those that
end on the line before the declaration; an attribute or decorator between hides them, and
exported TypeScript declarations have none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .languages import Parsed
from .symbols import _NAMES, _back, _comment_before, _last_line, _spans, functions, member_head

# Which tagged rule is which kind of symbol.
_KINDS = {
    "go": {"TypeSpec": "Type"},
    "python": {"Class": "Class"},
    "rust": {"Struct": "Struct", "Enum": "Enum", "Trait": "Trait", "TypeAlias": "Type", "Const": "Const"},
    "java": {"Class": "Class", "Interface": "Interface", "Enum": "Enum"},
    "c": {"StructSpec": "Struct", "EnumSpec": "Enum"},
    "ruby": {"Class": "Class", "Module": "Module"},
    "javascript": {"Class": "Class"},
    "typescript": {"Class": "Class", "Interface": "Interface", "TypeAlias": "Type", "Enum": "Enum"},
}
_SKIP_PARAMS = {"self", "mut", "ref", "&", "&&", "*", "**", "SPLAT", "BLOCKARG", "...", "const", "public", "private", "protected", "readonly", "final"}


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    params: list[str] = field(default_factory=list)
    comment: str | None = None
    comment_source: str | None = None
    publicness: str = "Unknown"
    export_kind: str = "Unknown"
    container: str | None = None


@dataclass
class Reexport:
    start_line: int
    end_line: int
    local_name: str
    exported_name: str
    source_specifier: str | None
    is_type_only: bool


def params(kinds: list[str], texts: list[str], name: int, dialect: str) -> list[str]:
    """Plain parameter names of the list that follows a name; destructured ones and self are left out."""
    i = name
    while i < len(kinds) and kinds[i] not in ("(", "ARGS", "{", "NL", ";", "=>", "$end"):
        i += 1
    if i >= len(kinds) or kinds[i] not in ("(", "ARGS"):
        return []
    depth, piece, pieces = 0, [], []
    for j in range(i, len(kinds)):
        k = kinds[j]
        if k in ("(", "[", "{", "ARGS", "IDX") or k == "<" and dialect != "python":
            depth += 1
        elif k in (")", "]", "}") or k == ">" and dialect != "python" and depth > 1:
            depth -= 1
            if not depth:
                break
        if depth == 1 and k == ",":
            pieces.append(piece)
            piece = []
        elif j > i:
            piece.append((k, texts[j], depth))
    pieces.append(piece)
    out = []
    for p in pieces:
        flat = [(k, t) for k, t, d in p if d == 1 or dialect in ("java", "c")]
        if dialect in ("java", "c"):
            before = []
            for k, t in flat:
                if k == "=" or k == "[" and dialect == "c":
                    break
                before.append((k, t))
            ids = [t for k, t in before if k in _NAMES]
            if ids and len(before) > 1:
                out.append(ids[-1])
            continue
        while flat and flat[0][0] in _SKIP_PARAMS | {"LIFE"}:
            flat = flat[1:]
        if flat and flat[0][0] not in ("{", "[", "(") and re.match(r"[^\W\d]", flat[0][1]) and flat[0][1] != "self":
            out.append(flat[0][1].rstrip(":"))
    return out


def _source(comment: str | None, dialect: str) -> str | None:
    if comment is None:
        return None
    if dialect == "rust":
        return "RustDoc" if re.search(r"(?m)^\s*(?:///|//!|/\*\*)", comment) else "PlainComment"
    return "JsDoc" if "/**" in comment else "PlainComment"


def _visibility(dialect: str, name: str, words: list[str], method: bool, private_none: bool = True) -> tuple[str, str]:
    if dialect == "rust":
        public = "Package" if words[:2] == ["pub", "("] else "Public" if words[:1] == ["pub"] else "Private"
        return public, "Named" if public != "Private" else "None"
    if dialect == "java":
        public = "Public" if "public" in words else "Private" if "private" in words else "Package"
        return public, "Named"
    if dialect == "c":
        return ("Private", "None") if "static" in words else ("Public", "Named")
    if name.startswith("_"):
        return "Private", "None"
    return ("Public" if name[:1].lower() != name[:1].upper() else "Unknown"), "Named"


def symbols(p: Parsed) -> list[Symbol]:
    """The symbols in the order of their lines."""
    t, dialect = p.tokens, p.dialect
    kinds, texts, lines = t.kinds, t.texts, t.lines
    script = dialect in ("javascript", "typescript")
    spans = sorted(_spans(p), key=lambda s: (s[1], -s[2]))
    exports = [(a, b) for tag, a, b in spans if tag == "Export"]
    owners = []  # (start, end, name) of what holds methods
    out: dict[tuple, Symbol] = {}
    taken: set[tuple[int, int]] = set()

    def comment(head: int, start: int, exported: bool) -> tuple[str | None, str | None]:
        text = None if exported else _comment_before(p, head, start)
        return text, _source(text, dialect)

    for tag, a, b in spans:
        kind = _KINDS.get(dialect, {}).get(tag)
        if tag == "Impl":
            body = next((i for i in range(a, b) if kinds[i] == "{"), b)
            named = [i for i in range(a, body) if kinds[i] == "for"] or [a]
            i = next((i for i in range(named[-1] + 1, body) if kinds[i] == "ID"), a)
            owners.append((body, b, texts[i]))
            continue
        if kind is None:
            continue
        key = a
        if tag != "TypeSpec" and not (script and tag == "TypeAlias"):
            while key < b and kinds[key] not in ("class", "struct", "enum", "union", "trait", "interface", "type", "const", "module", "namespace"):
                key += 1
        name = key if tag == "TypeSpec" else key + 1
        if script and tag == "TypeAlias":
            name = a + 1
        if name >= b or kinds[name] in ("{", "(", "extends", "BIN", ":"):
            continue
        if dialect == "c" and kinds[name + 1] != "{":
            continue
        if dialect == "rust" and tag == "Const" and (any(x <= a and b <= y for x, y, _ in owners) or kinds[name] != "ID"):
            continue
        start = a - 1 if tag == "TypeSpec" and a and kinds[a - 1] == "type" else a
        exported = any(x <= a and b <= y for x, y in exports)
        head = member_head(kinds, start) if dialect == "java" else start
        words = texts[head : key + 1]
        if dialect == "rust":
            while start and kinds[start - 1] in ("pub", ")", "unsafe"):
                start = _back(kinds, start - 1) - 1 if kinds[start - 1] == ")" else start - 1
            words = texts[start : start + 2]
        text, source = comment(start if dialect == "rust" else head, start, exported)
        if script:
            inside = any(tg in ("Func", "Method", "ArrowTail", "FuncExpr") and x < a and b <= y for tg, x, y in spans)
            if inside:
                continue
            publicness, export_kind = ("Public", "Default" if exported and texts[a - 1] == "default" else "Named") if exported else ("Private", "None")
        else:
            publicness, export_kind = _visibility(dialect, texts[name], words, False)
        last = b - 1
        while last > a and (not texts[last] or script and kinds[last] in (";",) and tag != "TypeAlias"):
            last -= 1
        if tag in ("Class", "Interface", "Enum", "Module", "Trait", "Record"):
            owners.append((name + 1, b, texts[name]))
        out[a, b] = Symbol(texts[name], kind, lines[start], _last_line(p, last), [], text, source, publicness, export_kind)
    names = {(lines[i], texts[i]): i for i in range(len(kinds) - 1, -1, -1)}
    for f in functions(p):
        i = names[f.start_line, f.name]
        inner = [o for o in owners if o[0] <= i < o[1]]
        owner = max(inner, default=None)
        if script and f.kind == "Function" and any(tg in ("Func", "Method", "ArrowTail", "FuncExpr") and x < i - 3 and i < y and not (tg == "Func" and texts[x : i + 1].count("function") == 1 and "{" not in texts[x:i]) for tg, x, y in spans):
            continue
        exported = script and f.kind == "Function" and any(x <= i < y for x, y in exports)
        container = owner[2] if owner and f.kind == "Method" else None
        if dialect == "go" and f.kind == "Method":
            close = i - 1
            j = _back(kinds, close)
            ids = [texts[x] for x in range(j, close) if kinds[x] == "ID"]
            container = ids[-1] if ids else None
        start = i
        if dialect == "java":
            start = member_head(kinds, i)
        elif dialect in ("rust", "c"):
            while start and kinds[start - 1] not in (";", "}", "{", "]") and lines[start - 1] == lines[i]:
                start -= 1
        elif dialect == "python":
            start = i - 1 - (kinds[i - 2] == "async" if i > 1 else 0)
        elif dialect in ("go", "ruby") or script:
            while start and lines[start - 1] == lines[i] and kinds[start - 1] not in (";", "}", "{", "NL", "DEDENT", "INDENT"):
                start -= 1
        text, source = comment(start, i, exported)
        if script:
            if f.kind == "Method":
                publicness, export_kind = "Private", "ModuleMember"
            else:
                publicness, export_kind = ("Public", "Default" if any(kinds[x + 1] == "default" for x, y in exports if x <= i < y) else "Named") if exported else ("Private", "None")
        else:
            publicness, export_kind = _visibility(dialect, f.name, texts[start:i], f.kind == "Method")
        span = (f.start_line, f.end_line)
        if span in taken and dialect not in ("javascript", "typescript"):
            continue
        taken.add(span)
        out[i, -1] = Symbol(f.name, f.kind, f.start_line, f.end_line, params(kinds, texts, i, dialect), text, source, publicness, export_kind, container)
    return sorted(out.values(), key=lambda s: (s.start_line, -s.end_line))


def reexports(p: Parsed) -> list[Reexport]:
    """export {a as b} [from 's'], export * from 's' and export * as n from 's' of a script."""
    if p.dialect not in ("javascript", "typescript"):
        return []
    t, out = p.tokens, []
    for tag, a, b in sorted(_spans(p), key=lambda s: (s[1], s[2])):
        if tag != "Export":
            continue
        i = a + 1
        type_only = t.kinds[i] == "type" and t.kinds[i + 1] in ("{", "*")
        i += type_only
        if t.kinds[i] not in ("{", "*"):
            continue
        end = b - 1
        while end > a and not t.texts[end]:
            end -= 1
        source = next((t.texts[j][1:-1] for j in range(b - 1, i, -1) if t.kinds[j] == "STR" and t.kinds[j - 1] == "from"), None)
        where = (t.lines[a], _last_line(p, end))
        if t.kinds[i] == "*":
            out.append(Reexport(*where, "*", t.texts[i + 2] if t.kinds[i + 1] == "as" else "*", source, type_only))
            continue
        close = next(j for j in range(i, b) if t.kinds[j] == "}")
        spec: list[str] = []
        own = False
        for j in range(i + 1, close + 1):
            if t.kinds[j] in (",", "}"):
                if spec:
                    out.append(Reexport(*where, spec[0], spec[-1], source, type_only or own))
                spec, own = [], False
            elif t.texts[j] == "type" and not spec and t.kinds[j + 1] not in (",", "}", "as"):
                own = True
            elif t.texts[j] != "as" or not spec:
                spec.append(t.texts[j].strip("\"'"))
    return out
