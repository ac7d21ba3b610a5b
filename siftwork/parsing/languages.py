"""Languages: which grammars a file extension is tried with."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from . import grammars, lexers
from .gll import AUTO_SEMI, EOF, Grammar, parse
from .gll import _step as step
from .lexers import Tokens

#: Extension to language.  A text is of a language if one of its dialects takes it; they run one
#: after the other, as most texts are taken by the first (see together()).
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "mts": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "rb": "ruby",
}
DIALECTS = {"typescript": ("typescript", "javascript"), "tsx": ("typescript", "tsx", "javascript")}
#: TypeScript files that may hold JSX elements count as TypeScript.
FAMILIES = {"tsx": "typescript"}


@dataclass
class Parsed:
    ok: bool
    dialect: str
    tokens: Tokens
    spans: set
    failed_at: int  # index of the first token that no dialect takes


@cache
def _tools(dialect: str) -> tuple[object, Grammar]:
    lexer = {"go": lexers.go_lexer, "python": lexers.PythonLexer, "rust": lexers.rust_lexer, "java": lexers.java_lexer, "c": lexers.c_lexer, "ruby": lexers.RubyLexer, "tsx": lexers.JsxLexer}.get(dialect)
    return lexer() if lexer else lexers.js_lexer(dialect == "typescript"), grammars.build(dialect)


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get((path or "").rpartition("/")[2].rpartition(".")[2])


def together(text: str, language: str) -> bool:
    """The same with all dialects at once: every dialect's start stands on one stack, token by token,
    until none is left.  Slower, as nearly all of a text has two readings; the tests compare."""
    running = []
    for dialect in DIALECTS.get(language, (language,)):
        lexer, grammar = _tools(dialect)
        tokens = lexer(text)
        if len(tokens.kinds) == 1:
            return True
        running.append([grammar, tokens, [(grammar.start[grammar.start_rule], None)]])
    i = 0
    while running:
        left = []
        for grammar, tokens, configs in running:
            k = tokens.kinds[i]
            after = step(grammar, configs, k, i, set())
            if not after and tokens.breaks is not None and (i in tokens.breaks or k in ("}", EOF)):
                after = step(grammar, step(grammar, configs, AUTO_SEMI, i, set()), k, i, set())
            if after and i + 1 == len(tokens.kinds):
                return True
            if after:
                left.append([grammar, tokens, after])
        running, i = left, i + 1
    return False


def read(text: str, language: str, wanted=None) -> Parsed | None:
    """Parses with every dialect of the language until one takes the whole text.

    With wanted, a condition on (tokens, dialect), texts that do not meet it are not parsed and give None.
    """
    best = None
    for dialect in DIALECTS.get(language, (language,)):
        lexer, grammar = _tools(dialect)
        tokens = lexer(text)
        if len(tokens.kinds) == 1:  # blank, or nothing but comments
            return Parsed(True, FAMILIES.get(dialect, dialect), tokens, set(), 0)
        if wanted and not wanted(tokens, dialect):
            return None
        ok, at, spans = parse(grammar, tokens.kinds, tokens.breaks)
        got = Parsed(ok, FAMILIES.get(dialect, dialect), tokens, spans, at)
        if ok:
            return got
        if best is None or at > best.failed_at:
            best = got
    return best


def recognises(text: str, language: str) -> str | None:
    """The first dialect of the language that takes the whole text, without keeping tokens."""
    for dialect in DIALECTS.get(language, (language,)):
        lexer, grammar = _tools(dialect)
        brief = getattr(lexer, "brief", None)
        if brief:
            kinds, breaks = brief(text)
        else:
            tokens = lexer(text)
            kinds, breaks = tokens.kinds, tokens.breaks
        if len(kinds) == 1 or parse(grammar, kinds, breaks)[0]:
            return dialect
    return None
