"""Lexers: text to token kinds for the grammars, with lines and comments beside them.

One compiled pattern cuts a file into lexemes in C; a table that remembers the kind of
every lexeme seen (bounded, and emptied when full) turns them into kinds.  A character
that starts no token becomes the kind BAD, which no grammar accepts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .gll import EOF

_KEEP = 200_000
_NL, _COMMENT, _LONG = "\n", "//", "STR\n"
ASYNC_FUNCTION = "async function"


class Lines:
    """The line of each token, from the tokens that begin a line."""

    def __init__(self, starts: list[int], size: int):
        self.starts, self.size = starts, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        return bisect_right(self.starts, i if i >= 0 else self.size + i) + 1


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    lines: list[int] | Lines = field(default_factory=list)  # 1-based line on which a token begins
    #: indexes of tokens that begin a line; None where statements end by token alone
    breaks: set[int] | None = None
    #: (index of the next token, first line, last line, text)
    comments: list[tuple[int, int, int, str]] = field(default_factory=list)

    def end(self, line: int) -> "Tokens":
        self.kinds.append(EOF)
        self.texts.append("")
        self.lines.append(line)
        return self


class _Kinds(dict):
    """Lexeme to kind."""

    def __init__(self, fixed: dict[str, str], classify):
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, s: str) -> str:
        k = self.classify(s)
        if len(s) < 32:  # longer ones, comments and strings, seldom come again
            if len(self) > _KEEP:
                self.clear()
                self.update(self.fixed)
            self[s] = k
        return k


_WORD = r"[^\W\d]\w*"
_DQ = r'"(?:[^"\\\n]++|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]++|\\[\s\S])*+'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_NUMBER = r"0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*|\.(?=[eE]\d))?(?:[eE][+-]?\d[\d_]*)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*"


def _ops(text: str) -> list[str]:
    return sorted(text.split(), key=len, reverse=True)


#: What most tokens are, tried first: a word that is no prefix of a string, or a lone mark.
_FREQUENT = r"[A-Za-z_][A-Za-z0-9_]*+(?![\w\"'#$])|[()\[\]{},;\n]|[.=:<>+\-*!?&|](?![.=:<>+\-*!?&|/~\d])"


def _pattern(*parts: str, ops: str, frequent: str = _FREQUENT) -> re.Pattern:
    """One group, so that findall gives the lexemes; blanks are taken along, not tried one by one."""
    return re.compile(r"[ \t\r\f]*+(" + "|".join([frequent, *parts, *(re.escape(o) for o in _ops(ops) if len(o) > 1), r"\n|\S"]) + ")")


def _classifier(ops: str, binary: str, more=None):
    known = set(ops.split())
    joined = set(binary.split())

    def classify(s: str) -> str:
        if s.isidentifier():  # keywords are in the table from the start
            return "ID"
        c = s[0]
        if more and (k := more(s)):
            return k
        if s.startswith(("//", "/*")) and len(s) > 1 and s not in known:
            return _COMMENT
        if c.isalpha() or c in "_$":
            return "ID"
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return "NUM"
        if c in "\"'`" and len(s) > 1:
            return _LONG if "\n" in s else "STR"
        if s in joined:
            return "BIN"
        return s if s in known else "BAD"

    return classify


class BraceLexer:
    """For languages whose blocks are in braces.

    auto says how statements end at line breaks: 'go' inserts a semicolon after certain
    tokens, 'js' leaves it to the parser (Tokens.breaks) but for restricted statements; an
    async before function is a kind of its own, as only there it begins a declaration.
    """

    def __init__(self, pattern: re.Pattern, kinds: _Kinds, auto: str = "", ends: frozenset = frozenset()):
        self.pattern, self.kinds, self.auto, self.ends = pattern, kinds, auto, ends
        # for brief(): '' for what is left out, and a mark for what spans or ends lines
        marks = {_NL: _NL, _LONG: "STR"}
        fixed = {s: marks.get(k, k) for s, k in kinds.fixed.items()}
        self.short = _Kinds(fixed, lambda s: ("\n" if auto and "\n" in s else "") if (k := kinds.classify(s)) == _COMMENT else marks.get(k, k))

    def brief(self, text: str) -> tuple[list[str], set[int] | None]:
        """Only the kinds (with the end) and the breaks: enough to recognise a text."""
        found = map(self.short.__getitem__, self.pattern.findall(text.removeprefix("\ufeff")))
        if not self.auto:
            kinds = [k for k in found if k and k != _NL]
            kinds.append(EOF)
            return kinds, None
        kinds, ends = [], self.ends
        if self.auto == "go":
            for k in found:
                if k == _NL:
                    if kinds and kinds[-1] in ends:
                        kinds.append(";")
                elif k:
                    kinds.append(k)
            if kinds and kinds[-1] in ends:
                kinds.append(";")
            kinds.append(EOF)
            return kinds, None
        starts: list[int] = []
        for k in found:
            if k == _NL:
                if kinds and kinds[-1] in ends:
                    kinds.append(";")
                starts.append(len(kinds))
            elif k:
                kinds.append(k)
        kinds.append(EOF)
        _async_functions(kinds)
        return kinds, set(starts)

    def __call__(self, text: str) -> Tokens:
        kinds, texts, ends = [], [], self.ends
        starts: list[int] = []  # the token that begins each further line
        comments = []
        lexemes = self.pattern.findall(text.removeprefix("\ufeff"))
        found = list(map(self.kinds.__getitem__, lexemes))
        special, at = {_NL, _COMMENT, _LONG}, 0
        for i in [i for i, k in enumerate(found) if k in special]:
            if i > at:
                kinds += found[at:i]
                texts += lexemes[at:i]
            at, k, s = i + 1, found[i], lexemes[i]
            if k == _LONG:
                kinds.append("STR")
                texts.append(s)
                starts += [len(kinds)] * s.count("\n")
                continue
            n = 1 if k == _NL else s.count("\n")
            if n and kinds and kinds[-1] in ends:
                kinds.append(";")
                texts.append("")
            if k == _COMMENT:
                comments.append((len(kinds), len(starts) + 1, len(starts) + n + 1, s))
            starts += [len(kinds)] * n
        kinds += found[at:]
        texts += lexemes[at:]
        if self.auto == "go" and kinds and kinds[-1] in ends:
            kinds.append(";")
            texts.append("")
        kinds.append(EOF)
        texts.append("")
        if self.auto == "js":
            _async_functions(kinds)
        return Tokens(kinds, texts, Lines(starts, len(kinds)), set(starts) if self.auto == "js" else None, comments)


def _async_functions(kinds: list[str]) -> None:
    if "async" in kinds:
        for i in [i for i, k in enumerate(kinds) if k == "async"]:
            if kinds[i + 1] == "function":
                kinds[i] = ASYNC_FUNCTION


# -- fixed values: keywords and operators of the languages -----------------------------

GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_OPS = "+ - * & ^ <- ! ++ -- := = ( ) [ ] { } , ; . ... : == != < <= > >= && || / % << >> &^ | += -= *= /= %= &= |= ^= <<= >>= &^= ~"
GO_BINARY = "== != < <= > >= && || / % << >> &^ |"
GO_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= &^="

JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new null return super switch this throw true false try typeof var void while await yield enum"
JS_CONTEXT = "as from of get set async static"
TS_WORDS = "public private protected"
TS_CONTEXT = "type declare namespace module abstract readonly keyof infer is asserts satisfies unique interface implements override"
JS_OPS = "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #"
JS_BINARY = "<= == != === !== / % ** << ^ && || ??"
JS_ASSIGN = ">>= >>>= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??="

RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
RUST_OPS = "{ } ( ) [ ] ; , < > <= >= == != + - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= >>= = => -> :: : . .. ... ..= @ # $ ? _ ~"
RUST_BINARY = ">>= <= == != / % ^ << += -= *= /= %= ^= &= |= <<="

JAVA_WORDS = "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while true false null void"
JAVA_PRIM = "boolean byte char double float int long short"
JAVA_CONTEXT = "record yield permits when sealed non"
JAVA_OPS = "{ } ( ) [ ] ; , < > <= >= == != + - * / % ^ ! ~ & | && || << ++ -- += -= *= /= %= ^= &= |= <<= >>= >>>= = ? : :: . ... @ ->"
JAVA_BINARY = "<= == != * / % ^ | && || <<"
JAVA_ASSIGN = ">>= >>>= += -= *= /= %= ^= &= |= <<="

C_WORDS = "break case continue default do else enum for goto if return sizeof struct switch typedef union while"
C_TYPES = "void char short int long float double signed unsigned _Bool _Complex bool"
C_QUALIFIERS = "const volatile restrict static extern inline register auto _Noreturn _Atomic __inline __restrict __extension__ _Thread_local constexpr"
C_OPS = "{ } ( ) [ ] ; , < > <= >= == != + - * / % ^ ! ~ & | && || << >> ++ -- += -= *= /= %= ^= &= |= <<= >>= = ? : . -> ..."
C_BINARY = "< > <= >= == != / % ^ | && || << >>"
C_ASSIGN = "+= -= *= /= %= ^= &= |= <<= >>="

PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PY_CONTEXT = "match case type"
PY_OPS = "( ) [ ] { } , : ; . ... = := -> @ + - * ** / // % & | ^ ~ << >> < > <= >= == != += -= *= /= //= %= &= |= ^= >>= <<= **= @="
PY_BINARY = "+ / // % & | ^ << >> < > <= >= == != and or"
PY_ASSIGN = "+= -= *= /= //= %= &= |= ^= >>= <<= **= @="

RUBY_WORDS = "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ BEGIN END"
RUBY_OPS = "( ) [ ] { } , : ; . &. :: .. ... = => -> + - * ** / % & | ^ ~ ! << >> < > <= >= <=> == === != =~ !~ && || ? += -= *= /= %= **= &= |= ^= <<= >>= &&= ||="
RUBY_BINARY = "/ % ^ << >> > <= >= <=> == === != =~ !~ && ||"
RUBY_ASSIGN = "+= -= *= /= %= **= &= |= ^= <<= >>= &&= ||="


def _words(*groups: str) -> dict[str, str]:
    return {w: w for g in groups for w in g.split()}


def _class(words: str, kind: str) -> dict[str, str]:
    return {w: kind for w in words.split()}


def go_lexer() -> BraceLexer:
    ends = frozenset("ID NUM STR ) ] } break continue fallthrough return ++ --".split())
    kinds = _Kinds({_NL: _NL} | _words(GO_WORDS) | _class(GO_ASSIGN, "ASG"), _classifier(GO_OPS, GO_BINARY))
    return BraceLexer(_pattern(_LINE, _BLOCK, r"`[^`]*`", _DQ, _SQ, _WORD, _NUMBER, ops=GO_OPS), kinds, "go", ends)


_REGEX = r"/(?:(?<=[(,=:\[!&|?{;+\-*%~^<>]/)|(?<=[(,=:\[!&|?{;+\-*%~^<>] /)|(?<=return /)|(?<=case /)|(?<=typeof /)|(?<=\n/)|(?<=\n  /)|(?<=\n    /))(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"


def js_lexer(typescript: bool) -> BraceLexer:
    def more(s: str) -> str:
        if s[0] == "`" and len(s) > 1:
            return "STR\n" if "\n" in s else "STR"
        if s[0] == "/" and len(s) > 2 and s[1] not in "/*":
            return "STR"
        if s[0] == "#" and len(s) > 1:
            return _COMMENT if s[1] == "!" else "ID"
        return ""

    words = _words(JS_WORDS, JS_CONTEXT) | (_words(TS_WORDS, TS_CONTEXT) if typescript else {})
    fixed = {_NL: _NL} | words | _class(JS_ASSIGN, "ASG")
    for op in ("<", ">"):
        fixed[op] = op
    pattern = _pattern(r"\A#!.*", _LINE, _BLOCK, _TEMPLATE, _DQ, _SQ, _REGEX, r"#?[^\W\d][\w$]*|#?\$[\w$]*", _NUMBER, ops=JS_OPS)
    return BraceLexer(pattern, _Kinds(fixed, _classifier(JS_OPS, JS_BINARY, more)), "js", frozenset(["return", "break", "continue", "throw"]))


class JsxLexer:
    """TypeScript with JSX elements: outside of them the tokens of the plain lexer; their tags, attributes
    and ends are kinds of their own, and their text is left out.

    A < begins an element where no operand can end before it and a name or > follows.
    """

    _tag = re.compile(r"<(?=[A-Za-z_$>])(?!\w+(?:,|\s+extends\b))")
    _generic = re.compile(r"<\w+>\s*\(")
    _name = re.compile(r"[A-Za-z_$][\w$\-]*(?:[:.][A-Za-z_$][\w$\-]*)*")
    _skip = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)+")
    _string = re.compile(r"\"[^\"]*\"|'[^']*'")
    _text = re.compile(r"[^<{]+")
    _close = re.compile(r"</\s*([A-Za-z_$][\w$\-]*(?:[:.][A-Za-z_$][\w$\-]*)*)?\s*>")
    _operand = frozenset("ID NUM STR ) ] } this super true false null ++ --".split())

    def __init__(self):
        self.plain = js_lexer(True)

    def __call__(self, text: str) -> Tokens:
        text = text.removeprefix("\ufeff")
        kinds, texts, comments = [], [], []
        starts: list[int] = []
        table, ends, match = self.plain.kinds, self.plain.ends, self.plain.pattern.match
        pos, modes = 0, [("js", 0, "")]  # (what is read, depth of braces, name of the element)

        def put(k: str, s: str) -> None:
            kinds.append(k)
            texts.append(s)
            starts.extend([len(kinds)] * s.count("\n"))

        def skip(m) -> int:
            starts.extend([len(kinds)] * m.group().count("\n"))
            return m.end()

        while pos < len(text):
            mode, depth, name = modes[-1]
            if mode == "text":
                if m := self._text.match(text, pos):
                    if ">" in m.group() or "}" in m.group():
                        put("BAD", "")
                    pos = skip(m)
                elif m := self._close.match(text, pos):
                    put("JCLOSE" if (m[1] or "") == name else "BAD", m.group())
                    modes.pop()
                    pos = m.end()
                elif m := self._tag.match(text, pos):
                    put("JOPEN", "<")
                    modes.append(("name", 0, ""))
                    pos = m.end()
                else:
                    put(text[pos] if text[pos] == "{" else "BAD", text[pos])
                    modes.append(("js", 0, "")) if text[pos] == "{" else None
                    pos += 1
            elif mode in ("name", "tag"):
                if m := self._skip.match(text, pos):
                    pos = skip(m)
                elif m := self._name.match(text, pos):
                    put("JNAME", m.group())
                    modes[-1] = ("tag", 0, m.group() if mode == "name" else name)
                    pos = m.end()
                elif m := self._string.match(text, pos):
                    put("STR", m.group())
                    pos = m.end()
                elif text.startswith("/>", pos):
                    put("JEND", "/>")
                    modes.pop()
                    pos += 2
                elif text[pos] == ">":
                    put("JGT", ">")
                    modes[-1] = ("text", 0, name)
                    pos += 1
                elif text[pos] == "{":
                    put("{", "{")
                    modes.append(("js", 0, ""))
                    pos += 1
                elif mode == "tag" and kinds[-1] == "=" and (m := self._tag.match(text, pos)):
                    put("JOPEN", "<")
                    modes.append(("name", 0, ""))
                    pos = m.end()
                else:
                    put("=" if text[pos] == "=" else "BAD", text[pos])
                    pos += 1
            else:
                m = match(text, pos)
                if not m:  # nothing but blanks is left
                    break
                s, at, last = m[1], m.start(1), kinds[-1] if kinds else ""
                if s[0] == "<" and last not in self._operand and self._tag.match(text, at) and not (last == ":" and self._generic.match(text, at)):
                    put("JOPEN", "<")
                    modes.append(("name", 0, ""))
                    pos = at + 1
                    continue
                k, pos = table[s], m.end()
                if k in (_NL, _COMMENT):
                    n = s.count("\n")
                    if n and last in ends:
                        put(";", "")
                    if k == _COMMENT:
                        comments.append((len(kinds), len(starts) + 1, len(starts) + n + 1, s))
                    starts.extend([len(kinds)] * n)
                    continue
                put("STR" if k == _LONG else k, s)
                if k == "{":
                    modes[-1] = (mode, depth + 1, name)
                elif k == "}" and depth == 0 and len(modes) > 1:
                    modes.pop()
                elif k == "}":
                    modes[-1] = (mode, max(0, depth - 1), name)
        if len(modes) > 1:
            put("BAD", "")
        kinds.append(EOF)
        texts.append("")
        _async_functions(kinds)
        return Tokens(kinds, texts, Lines(starts, len(kinds)), set(starts), comments)


def rust_lexer() -> BraceLexer:
    def more(s: str) -> str:
        if s[0] in "rb" and s[-1] in "\"#'" and len(s) > 1:
            return _LONG if "\n" in s else "STR"
        if s[0] == "'" and s[-1] != "'":
            return "LIFE"
        return ""

    nested = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
    char = r"b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x[\da-fA-F]{2}|.))'"
    raws = r'b?r"[^"]*"|b?r#"(?:[^"]|"(?!#))*"#|b?r##"(?:[^"]|"(?!##))*"##'
    pattern = _pattern(r"\A#!(?!\[).*", _LINE, nested, raws, "b?" + '"(?:[^"\\\\]++|\\\\[\\s\\S])*+"', char, r"'[^\W\d]\w*", r"r#\w+|" + _WORD, r"\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*", ops=RUST_OPS)
    fixed = {_NL: _NL, "_": "_"} | _words(RUST_WORDS)
    inner = _classifier(RUST_OPS, RUST_BINARY, more)
    return BraceLexer(pattern, _Kinds(fixed, lambda s: _COMMENT if s.startswith("#!/") else inner(s)))


def java_lexer() -> BraceLexer:
    fixed = {_NL: _NL} | _words(JAVA_WORDS, JAVA_CONTEXT) | _class(JAVA_PRIM, "PRIM") | _class(JAVA_ASSIGN, "ASG")
    pattern = _pattern(_LINE, _BLOCK, r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*"""', _DQ, _SQ, r"[^\W\d][\w$]*|\$[\w$]*", _NUMBER, ops=JAVA_OPS)
    return BraceLexer(pattern, _Kinds(fixed, _classifier(JAVA_OPS, JAVA_BINARY)))


def c_lexer() -> BraceLexer:
    def more(s: str) -> str:
        if s[0] in "uUL" and s[-1] in "\"'":
            return "STR"
        if s[0] == "#" or s[0] in " \t":
            return _COMMENT
        return ""

    # a directive counts as a comment; a # stands nowhere else
    directive = r"#[ \t]*\w*(?:\\\r?\n|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|[^\n\\/]|/(?![/*])|\\)*"
    fixed = {_NL: _NL} | _words(C_WORDS) | _class(C_TYPES, "TYPE") | _class(C_QUALIFIERS, "QUAL") | _class(C_ASSIGN, "ASG")
    pattern = _pattern(directive, _LINE, _BLOCK, r"(?:u8|[uUL])?" + _DQ, r"[uUL]?" + _SQ, _WORD, _NUMBER, ops=C_OPS)
    return BraceLexer(pattern, _Kinds(fixed, _classifier(C_OPS, C_BINARY, more)))


class PythonLexer:
    """Adds NL, INDENT and DEDENT; line breaks inside brackets do not count."""

    def __init__(self):
        p = r"(?:[rRuUbBfFtT]{1,2})?"
        self.pattern = _pattern(r"\n[ \t\f]*", r"#[^\n]*", r"\\\r?\n", p + r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*"""', p + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*'''", p + _DQ, p + _SQ, _WORD, _NUMBER, ops=PY_OPS + " <>", frequent=_FREQUENT.replace(r"\n", ""))

        def more(s: str) -> str:
            if s[0] == "\n":
                return _NL
            if s[0] == "#":
                return _COMMENT
            if s[0] == "\\":
                return _LONG if len(s) > 1 else "BAD"
            if s[-1] in "\"'" and len(s) > 1:
                return _LONG if "\n" in s else "STR"
            return ""

        fixed = {"\n": _NL} | _words(PY_WORDS, PY_CONTEXT) | _class(PY_ASSIGN, "ASG")
        fixed.update(_class("and or // /", "BIN"))
        self.kinds = _Kinds(fixed, _classifier(PY_OPS, PY_BINARY, more))

    def __call__(self, text: str) -> Tokens:
        t = Tokens()
        kinds, texts, lines, table = t.kinds, t.texts, t.lines, self.kinds
        special = {_NL, _COMMENT, _LONG, "(", "[", "{", ")", "]", "}"}
        line, depth, indents = 0, 0, [0]
        col, fresh = 0, True
        text = text.removeprefix("\ufeff")

        def put(k, s):
            kinds.append(k)
            texts.append(s)
            lines.append(line)

        for s in self.pattern.findall("\n" + text):
            k = table[s]
            if k == _NL:
                if not depth:
                    if not fresh:
                        put("NL", "")
                    col, fresh = len(s.expandtabs(8)) - 1, True
                line += 1
                continue
            if k == _COMMENT:
                t.comments.append((len(kinds), line, line, s))
                continue
            if k == _LONG and s[0] == "\\":
                line += 1
                continue
            if fresh and not depth:
                fresh, mark = False, len(kinds)
                if col > indents[-1]:
                    indents.append(col)
                    put("INDENT", "")
                elif col < indents[-1]:
                    while col < indents[-1]:
                        indents.pop()
                        put("DEDENT", "")
                    if col != indents[-1]:
                        put("BAD", "")
                for j in range(len(t.comments) - 1, -1, -1):  # comments belong to the token itself
                    if t.comments[j][0] != mark:
                        break
                    t.comments[j] = (len(kinds), *t.comments[j][1:])
            if k in special:
                if k == _LONG:
                    put("STR", s)
                    line += s.count("\n")
                    continue
                depth = depth + 1 if k in "([{" else max(0, depth - 1)
            kinds.append(k)
            texts.append(s)
            lines.append(line)
        if not fresh:
            put("NL", "")
        for _ in indents[1:]:
            put("DEDENT", "")
        return t.end(line)


class RubyLexer:
    """Line breaks end statements unless the line goes on; here-documents are strings."""

    _open = re.compile(r"<<([~-]?)([\"'`]?)([A-Za-z_]\w*)\2")
    _goes_on = frozenset("BIN ASG = , . &. :: ( [ { | && || + - * ** & < and or not => -> ? : ! NLX".split())
    _value = frozenset("ID CONST NUM STR SYM ) ] } end self nil true false IVAR".split())

    def __init__(self):
        nested = r'"(?:[^"\\#]++|\\[\s\S]|#(?!\{)|#\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\})*"'
        self.pattern = re.compile(
            "|".join(
                [
                    r"[a-z_][a-z0-9_]*+(?![\w?!:\"'])|[\n(),;\[\]{}]",  # most tokens, tried first
                    r"^=begin\b[\s\S]*?^=end[^\n]*",
                    r"#[^\n]*",
                    r"^__END__\r?$[\s\S]*",
                    nested,
                    r"'(?:[^'\\]++|\\[\s\S])*'",
                    r"`[^`\n]*`",
                    r"%[qQwWiIr]?(?:\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\|[^|\n]*\||![^!\n]*!)[imx]*",
                    r":\"(?:[^\"\\\n]|\\.)*\"|:[^\W\d]\w*[?!=]?(?![\w=])|(?<![:\w]):(?:\[\]=?|<=>|[=!]=|=~|<<|>>|[+\-*/<>]=?)",
                    r"[^\W\d]\w*[?!]?:(?!:)",
                    r"defined\?|[^\W\d]\w*[?!](?![=~])|[^\W\d]\w*",
                    r"@@?\w+|\$(?:\w+|.)",
                    r"0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?",
                    r"\\\r?\n",
                    r"<<[~-]?([\"'`]?)[A-Za-z_]\w*\1",
                    *(re.escape(o) for o in _ops(RUBY_OPS) if len(o) > 1),
                    r"\n|\S",
                ]
            ),
            re.M,
        )
        self.regex = re.compile(r"/(?:[^/\\\n]|\\.)*/[imxounse]*")
        self.words, self.known, self.binary, self.assign = set(RUBY_WORDS.split()), set(RUBY_OPS.split()), set(RUBY_BINARY.split()), set(RUBY_ASSIGN.split())

    def __call__(self, text: str) -> Tokens:
        t = Tokens()
        kinds, texts, lines = t.kinds, t.texts, t.lines
        text = text.removeprefix("\ufeff")
        line, pos, depth, waiting = 1, 0, [], []
        match = self.pattern.search
        while m := match(text, pos):
            s, pos = m.group(), m.end()
            c = s[0]
            last = kinds[-1] if kinds else "NL"
            if s.isidentifier() and c != "_":
                if last in (".", "&.") or last == "def" and s != "self" or s not in self.words:
                    kinds.append("CONST" if c.isupper() else "ID")
                else:
                    kinds.append(s)
                texts.append(s)
                lines.append(line)
                continue
            spaced = m.start() > 0 and text[m.start() - 1] in " \t"
            if c == "\n":
                here = line
                line += 1
                for word, loose in waiting:  # bodies of here-documents follow their line
                    body = re.compile(rf"{'[ \t]*' if loose else ''}{re.escape(word)}\r?$", re.M)
                    at = pos
                    while (e := body.search(text, at)) and e.start() and text[e.start() - 1] != "\n":
                        at = e.end()
                        if at >= len(text):
                            e = None
                            break
                    if not e:
                        kinds.append("BAD")
                        texts.append("")
                        lines.append(line)
                        pos = len(text)
                        break
                    line += text.count("\n", pos, e.end()) + 1
                    pos = min(e.end() + 1, len(text))
                waiting = []
                if (depth and depth[-1] in "([") or last == "NL" or last in self._goes_on and not (last == "|" and self._block_bar(kinds)):
                    continue
                rest = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*(&?\.(?!\.))").match(text, pos)
                if rest:
                    continue
                kinds.append("NL")
                texts.append("")
                lines.append(here)
                continue
            elif c == "#" or s.startswith("=begin") and "\n" in s or s.startswith("__END__"):
                n = s.count("\n")
                t.comments.append((len(kinds), line, line + n, s))
                line += n
                continue
            elif c == "\\" and len(s) > 1:
                line += 1
                continue
            elif s.startswith("<<") and len(s) > 2 and s != "<<=":
                h = self._open.fullmatch(s)
                if h and (h[1] or last not in self._value) or h and last == "ID" and spaced and not text[pos : pos + 1].isspace():
                    waiting.append((h[3], bool(h[1])))
                    k = "STR"
                else:
                    s, pos, k = "<<", m.start() + 2, "BIN"
            elif c == "/" and (last not in self._value or last == "ID" and spaced and text[m.start() + 1 : m.start() + 2] not in (" ", "=")) and (r := self.regex.match(text, m.start())):
                s, pos, k = r.group(), r.end(), "STR"
            elif c == "%" and len(s) > 1 and s != "%=" and last in self._value and not (last == "ID" and spaced):
                s, pos, k = "%", m.start() + 1, "BIN"
            elif c in "\"'`%" and len(s) > 1 and s != "%=":
                k = "STR"
            elif c == ":" and len(s) > 1 and s != "::":
                k = "SYM"
            elif c == "?" and last not in self._value and (r := re.compile(r"\?\\?[^\s]").match(text, m.start())):
                s, pos, k = r.group(), r.end(), "STR"
            elif (c.isalpha() or c == "_") and s[-1] == ":":
                if last == "?" or "?" in kinds[-6:] and spaced is False and text[pos : pos + 1] != " ":
                    s, pos = s[:-1], m.end() - 1
                    k = s if s in self.words else "CONST" if c.isupper() else "ID"
                else:
                    k = "LABEL"
            elif c.isalpha() or c == "_":
                if last in (".", "&.") or last == "def" and s != "self":
                    k = "CONST" if c.isupper() else "ID"
                else:
                    k = s if s in self.words else "CONST" if c.isupper() else "ID"
            elif c in "@$" and len(s) > 1:
                k = "IVAR"
            elif c.isdigit():
                k = "NUM"
            elif s in self.binary:
                k = "BIN"
            elif s in self.assign:
                k = "ASG"
            elif s == "[" and last in self._value and not (spaced and last == "ID"):
                k = "IDX"
            elif s == "(" and last in ("ID", "CONST", "super", "yield", "defined?", "not") and not spaced:
                k = "ARGS"
            elif s in "-*&" and last in ("ID",) and spaced and not text[pos : pos + 1].isspace():
                k = {"-": "UMINUS", "*": "SPLAT", "&": "BLOCKARG"}[s]
            else:
                k = s if s in self.known else "BAD"
            if s in ("(", "[", "{"):
                depth.append(s)
            elif s in (")", "]", "}") and depth:
                depth.pop()
            kinds.append(k)
            texts.append(s)
            lines.append(line)
            if len(s) > 1:
                line += s.count("\n")
        if waiting:
            kinds.append("BAD")
            texts.append("")
            lines.append(line)
        return t.end(line)

    @staticmethod
    def _block_bar(kinds: list[str]) -> bool:
        """Whether the last | closes the parameters of a block."""
        for i in range(len(kinds) - 2, max(-1, len(kinds) - 40), -1):
            if kinds[i] == "|":
                return i > 0 and kinds[i - 1] in ("do", "{")
        return False
