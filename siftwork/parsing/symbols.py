"""Functions and methods of a parsed file, with the comment or docstring of each.

Works on whatever was recognised: after a syntax error the parser goes on at the next
line that can begin a declaration or a member of a class, up to the end of the file, so
functions of broken files are found too.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

from . import grammars, lexers
from .gll import EOF, Grammar, parse
from .languages import Parsed, _tools

_MODIFIERS = frozenset(
    [lexers.ASYNC_FUNCTION, *"export default async const let var declare public private protected static abstract readonly override get set final native synchronized transient volatile strictfp pub unsafe extern QUAL".split()]
)
#: Before a bracket these begin a statement, though a JavaScript method may be called so.
_CONTROL = frozenset("if for while switch catch with function await return super this import".split())
_NAMES = frozenset(["ID", *lexers.JAVA_CONTEXT.split()])
_MEMBER_WORDS = frozenset("static async get set public private protected readonly abstract override @ *".split())
_OPENERS = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Function:
    name: str
    kind: str  # Function or Method
    start_line: int
    end_line: int
    doc: str | None  # as written, markers included
    doc_style: str  # 'comment', 'docstring' or ''
    signature: str  # the declaration's words, up to its body


def _back(kinds: list[str], i: int) -> int:
    """Index of the bracket that opens the one closed at i."""
    depth = 0
    while i >= 0:
        if kinds[i] in (")", "]", "}"):
            depth += 1
        elif kinds[i] in ("(", "[", "{", "IDX", "ARGS"):
            depth -= 1
            if not depth:
                return i
        i -= 1
    return -1


def _head(kinds: list[str], i: int) -> int:
    """First token of a declaration that begins at i, with its modifiers, decorators and attributes."""
    while i > 0:
        k = kinds[i - 1]
        if k in _MODIFIERS:
            i -= 1
            continue
        j = i - 1
        if k in (")", "]"):
            j = _back(kinds, j)
            if k == "]" and j > 0 and kinds[j - 1] == "#":
                i = j - 1
                continue
            if k == ")" and j > 0 and kinds[j - 1] == "pub":
                i = j - 1
                continue
            j -= 1
        while j > 1 and kinds[j] in _NAMES and kinds[j - 1] == ".":
            j -= 2
        if j > 0 and kinds[j] in _NAMES and kinds[j - 1] == "@":
            i = j - 1
            continue
        break
    return i


def member_head(kinds: list[str], i: int) -> int:
    """First token of a class member: the one after the last brace or semicolon."""
    while i > 0 and kinds[i - 1] not in (";", "{", "}"):
        i = _back(kinds, i - 1) if kinds[i - 1] == ")" else i - 1
    return max(i, 0)


def _comment_before(p: Parsed, head: int, start: int) -> str | None:
    """The run of whole-line comments that ends on the line before the declaration."""
    comments, lines = p.tokens.comments, p.tokens.lines
    i = bisect_right(comments, start, key=lambda c: c[0]) - 1
    while i >= 0 and comments[i][0] >= head:
        at, first, last, _ = comments[i]
        if last + 1 == lines[at] and _before(p, at) < first:
            break
        i -= 1
    if i < 0 or comments[i][0] < head:
        return None
    at = comments[i][0]
    run = [comments[i]]
    while i > 0 and comments[i - 1][0] == at and comments[i - 1][2] + 1 == run[0][1]:
        i -= 1
        if _before(p, at) >= comments[i][1]:
            break
        run.insert(0, comments[i])
    return "\n".join(c[3].strip() for c in run)


def _before(p: Parsed, i: int) -> int:
    """The last line of the token before one; changes of indentation stand on no line of their own."""
    i -= 1
    while i >= 0 and p.tokens.kinds[i] in ("INDENT", "DEDENT"):
        i -= 1
    return _last_line(p, i) if i >= 0 else 0


def _last_line(p: Parsed, i: int) -> int:
    return p.tokens.lines[i] + p.tokens.texts[i].count("\n")


@cache
def _rest(dialect: str) -> Grammar | None:
    return grammars.build(dialect, rest=True)


def _attempts(dialect: str, kinds: list[str], at: int, begins: set[str]) -> list[Grammar]:
    """The grammars that may go on at the first token of a line."""
    k, rest = kinds[at], _rest(dialect)
    if dialect == "go":
        return [rest] if k in ("func", "var", "const", "type") else []
    if dialect == "java":
        if k in ("import", "package"):
            return [_tools(dialect)[1]]
        return [rest] if k not in (";", "{", "}") and k in rest.choices[rest.start[rest.start_rule]] else []
    out = [_tools(dialect)[1]] if k in begins else []
    if rest and k not in _CONTROL and (k in _MEMBER_WORDS or kinds[at + 1] in ("(", "<", "?", "!")):
        out.append(rest)
    return out


def _spans(p: Parsed) -> set:
    """The spans of the whole file, going on after each syntax error."""
    spans = set(p.spans)
    if p.ok:
        return spans
    grammar = _tools(p.dialect)[1]
    kinds, lines, at, last = p.tokens.kinds, p.tokens.lines, p.failed_at, -1
    begins = set(grammar.choices[grammar.start[grammar.start_rule]]) - {"ID", ";", "NL"}
    while True:
        at = min(at, len(kinds) - 1)
        while at > last + 1 and lines[at - 1] == lines[at]:
            at -= 1
        at = max(at, last + 1)
        while at < len(kinds) - 1 and not ((at == 0 or lines[at] != lines[at - 1]) and (tries := _attempts(p.dialect, kinds, at, begins))):
            at += 1
        if at >= len(kinds) - 1:
            return spans
        best = None
        for g in tries:
            ok, end, more = parse(g, kinds, p.tokens.breaks, at)
            if best is None or end > best[1]:
                best = ok, end, more, g
        ok, end, more, g = best
        if g is not grammar and p.dialect in ("javascript", "typescript"):  # a call, or a statement, is no method
            more = {(tag, a, b) for tag, a, b in more if tag != "Method" or kinds[b - 1] == "}" and kinds[a - 1] not in _CONTROL}
        spans |= more
        if ok:
            return spans
        last, at = at, end


def has_documentation(tokens: lexers.Tokens, dialect: str) -> bool:
    """Whether there is a comment, or in Python a string that begins a block: else no function is documented."""
    if tokens.comments or dialect != "python":
        return bool(tokens.comments)
    kinds = tokens.kinds
    return any(a == "INDENT" and b == "STR" for a, b in zip(kinds, kinds[1:]))


def functions(p: Parsed, documented: bool = False) -> list[Function]:
    """The functions in the order of their names' places; with documented only those with a comment or docstring."""
    if documented and not has_documentation(p.tokens, p.dialect):
        return []
    t, dialect = p.tokens, p.dialect
    kinds, texts, lines = t.kinds, t.texts, t.lines
    spans = _spans(p)
    by = {}
    for tag, a, b in spans:
        by.setdefault(tag, []).append((a, b))
    found = []  # (start token, name token, end token, kind, first token of the body or -1)
    if dialect == "go":
        receivers = dict(by.get("Receiver", ()))
        for a, b in by.get("FuncDecl", ()):
            name = receivers.get(a + 1, a + 1)
            if kinds[name] != "ID":
                name = a + 1
            found.append((a, name, b, "Method" if name > a + 1 else "Function"))
    elif dialect == "python":
        classes = by.get("Class", ())
        for a, b in by.get("Def", ()):
            found.append((a - (kinds[a - 1] == "async" if a else 0), a + 1, b, "Method" if any(x < a and b <= y for x, y in classes) else "Function"))
    elif dialect == "rust":
        owners = [*by.get("Impl", ()), *by.get("Trait", ())]
        for a, b in by.get("Fn", ()):
            name = a
            while name < b and kinds[name] != "fn":
                name += 1
            found.append((a, name + 1, b, "Method" if any(x < a and b <= y for x, y in owners) else "Function"))
    elif dialect == "java":
        for a, b in by.get("Method", ()):
            found.append((a - 1, a - 1, b, "Method"))
    elif dialect == "c":
        bodies = {b: a for a, b in by.get("Body", ())}
        for a, b in by.get("External", ()):
            if b in bodies:
                name = next((i for i in range(a, bodies[b]) if kinds[i] == "ID" and kinds[i + 1] == "("), -1)
                if name >= 0:
                    found.append((a, name, b, "Function"))
    elif dialect == "ruby":
        for a, b in by.get("Def", ()):
            name = a + 1
            while kinds[name + 1] == ".":
                name += 2
            found.append((a, name, b, "Method"))
    else:
        for a, b in by.get("Func", ()):
            name = next(i for i in range(a, b) if kinds[i] == "function") + 1
            name += kinds[name] == "*"
            if kinds[name] not in ("(", "<") and not (a and kinds[a - 1] in ("=", "(", ",", "ASG", "return", ":", "=>")):
                found.append((a, name, b, "Function"))
        for a, b in by.get("Method", ()):
            name = a - 1
            name -= texts[name] in ("?", "!") and name > 0
            if kinds[name] != "]":
                found.append((name, name, b, "Method"))
        inits, arrows = {}, {}  # the starts of those that end at a token
        for starts, tag in ((inits, "Init"), (arrows, "ArrowTail")):
            for s, e in by.get(tag, ()):
                starts.setdefault(e, []).append(s)
        ends = {e for _, e in by.get("FuncExpr", ())} | arrows.keys()
        for a, b in by.get("VarDecl", ()):
            if b not in ends:
                continue
            init = min((s for s in inits.get(b, ()) if s >= a), default=-1)
            if init < 0:
                continue
            if kinds[init + 1] in ("function", lexers.ASYNC_FUNCTION):
                found.append((a, a, b, "Function"))
            elif any(_arrow_of(kinds, init + 1, s) for s in arrows.get(b, ())):
                found.append((a, a, b, "Function"))
    decorated = {e: s for s, e in by.get("Decorated", ())}
    out = []
    for a, name, b, kind in sorted(set(found)):
        head = member_head(kinds, a) if dialect == "java" else decorated.get(b, a) if dialect == "python" else _head(kinds, a)
        doc, style = _comment_before(p, head, a), "comment"
        if dialect == "python":
            body = kinds.index("INDENT", name, b) if "INDENT" in kinds[name:b] else -1
            if 0 < body < b - 1 and kinds[body + 1] == "STR" and kinds[body + 2] in ("NL", ";") and texts[body + 1][:1] in "\"'rRuU":
                doc, style = texts[body + 1], "docstring"
        if documented and not doc:
            continue
        stop = next((i for i in range(name, b) if kinds[i] in ("{", "=>", "INDENT") or kinds[i] == "NL" and dialect == "ruby"), b)
        last = b - 1
        while last > a and not texts[last]:
            last -= 1
        out.append(Function(texts[name], kind, lines[name], _last_line(p, last), doc, style if doc else "", " ".join(x for x in texts[head:stop] if x)))
    return out


def _arrow_of(kinds: list[str], first: int, arrow: int) -> bool:
    """Whether the arrow at a token belongs to the expression that begins at first."""
    i = first + (kinds[first] == "async")
    if kinds[i] == "<":
        while kinds[i] not in ("(", EOF):
            i += 1
    if kinds[i] != "(":
        return i + 1 == arrow
    depth = 0
    while i < arrow:
        depth += (kinds[i] == "(") - (kinds[i] == ")")
        i += 1
        if not depth:
            return True if i == arrow else kinds[i] == ":"
    return False
