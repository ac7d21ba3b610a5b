"""Generalised LL parsing over recursive transition networks.

A grammar is written in EBNF.  Every rule becomes a deterministic automaton over
terminals and rule names, so a rule call is one push however its right side was
written.  The parser reads the token kinds from left to right:

* where the LL(1) table has a single choice, it follows a chain of pushes that was
  worked out when the grammar was compiled (one dictionary lookup a token);
* where it has several, all are followed together over a graph-structured stack:
  calls of one rule at one position share a node, and stacks that meet again are
  merged.  When a single stack is left, the parser returns to the table;
* what came of such a stretch is remembered by its first state, the calls it returned
  from and its tokens, so the same stretch is not followed again (Grammar.memory).

``EOF`` is the kind that ends the input.  ``AUTO_SEMI`` is a virtual statement end: where a
token does not fit and a line break (or a closing brace, or the end) precedes it,
the parser retries as if the statement had ended there.

Grammar notation: ``Rule = a 'lit' KIND [optional] {repeated} (group | other) ;``.  Names
in capitals are token classes, other names are rules.  A rule whose name is
preceded by ``@`` is reported as a span (name, first token, end token).
"""

from __future__ import annotations

import re
from collections import Counter

EOF = "$end"
AUTO_SEMI = ";auto"
_TOP = "$top"

_META = re.compile(r"'(?:[^'\\]|\\.)+'|[A-Za-z_]\w*|[=|;()\[\]{}@]")


class _Row(dict):
    """A row of the LL(1) table, worked out as it is used."""

    def __init__(self, grammar: "Grammar", q: int):
        self.grammar, self.q = grammar, q

    def __missing__(self, k: str):
        act = self[k] = self.grammar._chain(self.q, k) if k in self.grammar.choices[self.q] else 0
        return act


class Grammar:
    """A compiled grammar.

    prefer maps (rule, terminal) to the rule name that is taken where several would
    fit, for choices that a language settles by fiat (a brace at the start of a
    statement opens a block, not an object).  greedy names rules that go on for as
    long as they can (an else belongs to the nearest if), except before the terminals
    after an exclamation mark.
    """

    def __init__(self, text: str, start: str, prefer: dict[tuple[str, str], str] | None = None, classes: dict[str, list[str]] | None = None, greedy: str = ""):
        words = [w.partition("!") for w in greedy.split()]
        self.greedy = {w[0]: set(w[2].split(",")) for w in words}
        self.rules: dict[str, tuple] = {}
        self.tagged: set[str] = set()
        self._classes = classes or {}
        self._read(text)
        self._inline({start, *(r for r, _ in prefer or {}), *(prefer or {}).values(), *self.greedy, *self.tagged})
        self.rules[_TOP] = ("seq", [("n", start), ("t", EOF)])
        self.start_rule = _TOP
        self._build(prefer or {})

    # -- reading the notation ------------------------------------------------------

    def _read(self, text: str) -> None:
        toks = _META.findall(re.sub(r"(?m)^\s*#.*$", "", text))
        pos = 0

        def alt():
            nonlocal pos
            options = [seq()]
            while toks[pos] == "|":
                pos += 1
                options.append(seq())
            return options[0] if len(options) == 1 else ("alt", options)

        def seq():
            nonlocal pos
            parts = []
            while toks[pos] not in ("|", ")", "]", "}", ";"):
                t = toks[pos]
                pos += 1
                if t in "([{":
                    inner = alt()
                    pos += 1
                    parts.append({"(": inner, "[": ("opt", inner), "{": ("rep", inner)}[t])
                elif t[0] == "'":
                    parts.append(("t", t[1:-1].replace("\\", "")))
                elif t in self._classes:
                    parts.append(("alt", [("t", k) for k in self._classes[t]]))
                elif t.isupper():
                    parts.append(("t", t))
                else:
                    parts.append(("n", t))
            return ("seq", parts)

        while pos < len(toks):
            tag = toks[pos] == "@"
            name = toks[pos + tag]
            pos += 2 + tag
            if name in self.rules:
                raise ValueError(f"rule {name} is given twice")
            self.rules[name] = alt()
            pos += 1
            if tag:
                self.tagged.add(name)

    def _inline(self, kept: set[str], most: int = 60, growth: int = 600) -> None:
        """Puts small rules that do not call themselves into their callers: fewer calls, and
        alternatives that begin alike share their states."""

        def names(x) -> Counter:
            if x[0] in ("t", "n"):
                return Counter({x: 1})
            return names(x[1]) if x[0] in ("opt", "rep") else sum(map(names, x[1]), Counter())

        def put(x, name: str, body):
            if x[0] in ("t", "n"):
                return body if x == ("n", name) else x
            if x[0] in ("opt", "rep"):
                return (x[0], put(x[1], name, body))
            return (x[0], [put(y, name, body) for y in x[1]])

        held = {r: names(b) for r, b in self.rules.items()}
        for name in [r for r in self.rules if r not in kept]:
            body, own, me = self.rules[name], held[name], ("n", name)
            n = sum(h[me] for h in held.values())
            if own[me] or own.total() > most or own.total() * n > growth:
                continue
            del self.rules[name], held[name]
            for r, h in held.items():
                if times := h.pop(me, 0):
                    self.rules[r] = put(self.rules[r], name, body)
                    for x, c in own.items():
                        h[x] += c * times

    # -- automata and tables ---------------------------------------------------------

    def _build(self, prefer: dict[tuple[str, str], str]) -> None:
        nullable: set[str] = set()

        def empty(x) -> bool:
            kind = x[0]
            if kind == "seq":
                return all(map(empty, x[1]))
            if kind == "alt":
                return any(map(empty, x[1]))
            return kind in ("opt", "rep") or kind == "n" and x[1] in nullable

        size = -1
        while size != len(nullable):
            size = len(nullable)
            nullable |= {n for n, body in self.rules.items() if empty(body)}

        trans: list[dict] = []
        final: list[bool] = []
        owner: list[str] = []
        start: dict[str, int] = {}
        for name, body in self.rules.items():
            eps: list[set[int]] = []
            edges: list[list[tuple[tuple, int]]] = []

            def node() -> int:
                eps.append(set())
                edges.append([])
                return len(eps) - 1

            def build(x, a: int) -> int:
                kind = x[0]
                if kind in ("t", "n"):
                    if kind == "n" and x[1] not in self.rules:
                        raise ValueError(f"{name}: no rule {x[1]}")
                    b = node()
                    edges[a].append((x, b))
                    if kind == "n" and x[1] in nullable:
                        eps[a].add(b)
                    return b
                if kind == "seq":
                    for part in x[1]:
                        a = build(part, a)
                    return a
                if kind == "alt":
                    b = node()
                    for part in x[1]:
                        c = node()
                        eps[a].add(c)
                        eps[build(part, c)].add(b)
                    return b
                c = node()
                eps[a].add(c)
                d = build(x[1], c)
                b = node()
                eps[d].add(b)
                eps[c].add(b)
                if kind == "rep":
                    eps[d].add(c)
                return b

            first = node()
            last = build(body, first)

            def closed(states) -> frozenset:
                out, todo = set(states), list(states)
                while todo:
                    for e in eps[todo.pop()]:
                        if e not in out:
                            out.add(e)
                            todo.append(e)
                return frozenset(out)

            begin = closed([first])
            ids = {begin: len(trans)}
            start[name] = len(trans)
            trans.append({})
            final.append(last in begin)
            owner.append(name)
            todo = [begin]
            while todo:
                here = todo.pop()
                moves: dict[tuple, set[int]] = {}
                for s in here:
                    for sym, to in edges[s]:
                        moves.setdefault(sym, set()).add(to)
                for sym, to in moves.items():
                    there = closed(to)
                    if there not in ids:
                        ids[there] = len(trans)
                        trans.append({})
                        final.append(last in there)
                        owner.append(name)
                        todo.append(there)
                    trans[ids[here]][sym] = ids[there]

        n = len(trans)
        first_of: dict[str, set[str]] = {r: set() for r in self.rules}
        changed = True
        while changed:
            changed = False
            for r in self.rules:
                got = {s[1] for s in trans[start[r]] if s[0] == "t"}
                for s in trans[start[r]]:
                    if s[0] == "n":
                        got |= first_of[s[1]]
                if not got <= first_of[r]:
                    first_of[r] |= got
                    changed = True
        state_first = [set().union(*(first_of[s[1]] if s[0] == "n" else {s[1]} for s in trans[q])) if trans[q] else set() for q in range(n)]
        follow: dict[str, set[str]] = {r: set() for r in self.rules}
        changed = True
        while changed:
            changed = False
            for q in range(n):
                for s, to in trans[q].items():
                    if s[0] == "n":
                        got = state_first[to] | (follow[owner[q]] if final[to] else set())
                        if not got <= follow[s[1]]:
                            follow[s[1]] |= got
                            changed = True

        self.tail = [final[q] and not trans[q] for q in range(n)]
        self.start, self.final, self.owner, self.follow = start, final, owner, follow
        # choices[q][kind]: (None, next state) to read it, (rule, state to return to) to call
        self.choices: list[dict[str, list[tuple]]] = []
        for q in range(n):
            row: dict[str, list[tuple]] = {}
            for s, to in trans[q].items():
                if s[0] == "t":
                    row.setdefault(s[1], []).append((None, to))
                else:
                    for k in first_of[s[1]]:
                        row.setdefault(k, []).append((s[1], to))
            for (rule, k), wanted in prefer.items():
                if owner[q] == rule and k in row:
                    row[k] = [c for c in row[k] if c[0] == wanted] or row[k]
            self.choices.append(row)
        # table[q][kind]: (pushes, next state), None where several choices are open, 0 where there is none
        self.table = [_Row(self, q) for q in range(n)]
        # the state after a return to an unknown caller: nothing fits there
        self.unknown = n
        self.choices.append({})
        self.final.append(False)
        self.tail.append(False)
        self.owner.append(_TOP)
        #: what open choices came to, see _foreseen()
        self.memory: dict[tuple, dict] = {}
        self.remembered = 0

    def _stays(self, q: int, k: str) -> bool:
        return k not in self.greedy.get(self.owner[q], (k,))

    def _chain(self, q: int, k: str) -> tuple | None:
        pushes = []
        for _ in range(200):
            options = self.choices[q].get(k, ())
            if len(options) != 1 or self.final[q] and k in self.follow[self.owner[q]] and not self._stays(q, k):
                return None
            rule, to = options[0]
            if rule is None:
                return tuple(pushes), to
            tag = rule if rule in self.tagged else None
            if tag or not self.tail[to]:
                pushes.append((tag, to))
            q = self.start[rule]
        return None

    def conflicts(self) -> list[tuple[str, str]]:
        """(rule, terminal) pairs that need the graph-structured stack."""
        return sorted({(self.owner[q], k) for q, row in enumerate(self.table) for k in self.choices[q] if row[k] is None})


# A rule call on the stack is a tuple (state to return to, stack below, tag, first token), or
# a _Node where several stacks share it.


class _Node:
    """A shared rule call: more holds further pairs of a state to return to and the stack below."""

    __slots__ = ("ret", "below", "tag", "at", "more")

    def __init__(self, ret, below, tag, at):
        self.ret, self.below, self.tag, self.at, self.more = ret, below, tag, at, []


def _step(g: Grammar, configs: list, k: str, i: int, spans: set) -> list:
    """One token over the graph-structured stack: all configurations that can read k."""
    after: dict[tuple, tuple] = {}
    calls: dict[str, _Node] = {}
    returned: set[int] = set()
    seen: dict[tuple, _Node | None] = {}  # keeps the nodes alive, as their ids are keys
    work = list(configs)
    while work:
        q, u = work.pop()
        if (q, id(u)) in seen:
            continue
        seen[q, id(u)] = u
        for rule, to in g.choices[q].get(k, ()):
            if rule is None:
                after[to, id(u)] = (to, u)
                continue
            tag = rule if rule in g.tagged else None
            if g.tail[to] and not tag:
                work.append((g.start[rule], u))
                continue
            v = calls.get(rule)
            if v is None:
                calls[rule] = v = _Node(to, u, tag, i)
                work.append((g.start[rule], v))
            elif not (v.ret == to and v.below is u) and not any(r == to and b is u for r, b in v.more):
                v.more.append((to, u))
                if id(v) in returned:
                    work.append((to, u))
        if g.final[q] and u is not None and k in g.follow[g.owner[q]] and not (k in g.choices[q] and g._stays(q, k)):
            if u.__class__ is tuple:
                ret, below, tag, at = u
            else:
                ret, below, tag, at = u.ret, u.below, u.tag, u.at
                returned.add(id(u))
                work.extend(u.more)
            if tag:
                spans.add((tag, at, i))
            work.append((ret, below))
    return list(after.values())


# Stretches of tokens over which several choices are open, and what each came to.  A leaf of
# Grammar.memory is an outcome, or says that more of the stack has to be known, or that the
# stretch has to be followed each time.

_MORE_STACK, _EACH_TIME = "more stack", "each time"
_MOST_FRAMES, _MOST_TOKENS, _MOST_REMEMBERED = 8, 24, 200_000


class _Bottom:
    """Stands for the part of a stack that is not known."""

    __slots__ = ("unknown", "reached")
    below, tag, at, more = None, None, 0, ()

    def __init__(self, unknown: int):
        self.unknown, self.reached = unknown, False

    @property
    def ret(self) -> int:
        self.reached = True
        return self.unknown


def _outcome(q: int, u, bottom, known: dict[int, int], taken: int, spans: set):
    """(tokens taken, state, frames to drop, calls to push, spans), if the new part of the stack is one chain."""
    pushes = []
    while u is not bottom and id(u) not in known:
        if u.more:
            return _EACH_TIME
        pushes.append((u.ret, u.tag, u.at))
        u = u.below
    return taken, q, known.get(id(u), len(known)), tuple(reversed(pushes)), tuple(spans)


def _follow(g: Grammar, key: tuple, kinds: list[str], i: int):
    """Follows the open choices at token i and remembers the outcome; key is the state and the calls that are known."""
    q, frames = key[0], key[1:]
    ends = bool(frames) and frames[-1] is None
    bottom = u = None if ends else _Bottom(g.unknown)
    stack, known = [], {}
    for d in range(len(frames) - ends - 1, -1, -1):
        u = (frames[d][0], u, frames[d][1], -1 - d)
        stack.append(u)
        known[id(u)] = d
    if g.remembered > _MOST_REMEMBERED:
        g.memory.clear()
        g.remembered = 0
    tree, configs, spans, last = g.memory.setdefault(key, {}), [(q, u)], set(), len(kinds) - 1
    for n in range(_MOST_TOKENS):
        k = kinds[i + n]
        configs = _step(g, configs, k, n, spans)
        if bottom is not None and bottom.reached:
            leaf = _MORE_STACK
        elif not configs or i + n == last or n == _MOST_TOKENS - 1:
            leaf = _EACH_TIME
        elif len(configs) == 1 and not (configs[0][1].__class__ is _Node and configs[0][1].more):
            leaf = _outcome(*configs[0], bottom, known, n, spans)
        else:
            below = tree.get(k)
            if below.__class__ is not dict:
                below = tree[k] = {}
                g.remembered += 1
            tree = below
            continue
        tree[k] = leaf
        g.remembered += 1
        return leaf


def _foreseen(g: Grammar, q: int, u, kinds: list[str], i: int, spans: set) -> tuple | None:
    """(state, stack, token) at which the open choices at token i have come down to one; None if it is not known."""
    key, frame, ats = (q,) if u is not None else (q, None), u, []
    while True:
        got, j = g.memory.get(key), i
        while got.__class__ is dict:
            got = got.get(kinds[j])
            j += 1
        if got is None:
            got = _follow(g, key, kinds, i)
        if got is _EACH_TIME:
            return None
        if got is not _MORE_STACK:
            break
        if len(ats) == _MOST_FRAMES:
            return None
        if frame.__class__ is tuple:
            ret, frame, tag, at = frame
        elif frame.more:
            return None
        else:
            ret, tag, at, frame = frame.ret, frame.tag, frame.at, frame.below
        ats.append(at)
        key = (*key, (ret, tag)) if frame is not None else (*key, (ret, tag), None)
    taken, q, drop, pushes, ended = got
    for tag, a, b in ended:
        spans.add((tag, a + i if a >= 0 else ats[-1 - a], b + i))
    for _ in range(drop):
        u = u[1] if u.__class__ is tuple else u.below
    for ret, tag, a in pushes:
        u = (ret, u, tag, a + i)
    return q, u, i + taken


def _settled(g: Grammar, q: int, u, k: str, i: int, spans: set) -> tuple | None:
    """The configuration after k, where no choice is open; None where one is, or k does not fit."""
    while not (act := g.table[q][k]):
        if act is None or not g.final[q] or u is None or u.__class__ is _Node and u.more:
            return None
        q, u, tag, at = u if u.__class__ is tuple else (u.ret, u.below, u.tag, u.at)
        if tag:
            spans.add((tag, at, i))
    for tag, to in act[0]:
        u = (to, u, tag, i)
    return act[1], u


def parse(g: Grammar, kinds: list[str], breaks: set[int] | None = None, at: int = 0) -> tuple[bool, int, set]:
    """(accepted, index of the token that did not fit, spans of tagged rules).

    kinds must end with EOF.  breaks holds the indexes of tokens that a line break
    precedes, and is None for languages without automatic statement ends.
    """
    table, final, spans = g.table, g.final, set()
    q, u, i, n = g.start[g.start_rule], None, at, len(kinds)
    while i < n:
        k = kinds[i]
        q0, u0 = q, u
        while True:
            act = table[q][k]
            if act:
                pushes, q = act
                for tag, to in pushes:
                    u = (to, u, tag, i)
                break
            if act == 0 and final[q] and u is not None:
                if u.__class__ is tuple:
                    q, u, tag, at = u
                    if tag:
                        spans.add((tag, at, i))
                    continue
                if not u.more:
                    if u.tag:
                        spans.add((u.tag, u.at, i))
                    q, u = u.ret, u.below
                    continue
            if act is None and (known := _foreseen(g, q, u, kinds, i, spans)):
                q, u, i = known
                break
            if act == 0 and breaks is not None and not (u.__class__ is _Node and u.more) and (i in breaks or k == "}" or k == EOF):
                known = _settled(g, q0, u0, AUTO_SEMI, i, spans)
                if known and (known := _settled(g, *known, k, i, spans)):
                    q, u = known
                    break
            configs = _step(g, [(q, u)], k, i, spans) if act is None or u.__class__ is _Node and u.more else []
            before = [(q0, u0)]
            while True:
                if not configs and breaks is not None and (i in breaks or k == "}" or k == EOF):
                    configs = _step(g, _step(g, before, AUTO_SEMI, i, spans), k, i, spans)
                if not configs:
                    return False, i, spans
                if len(configs) == 1 and not (configs[0][1].__class__ is _Node and configs[0][1].more):
                    break
                i += 1
                if i == n:
                    return True, n, spans
                k, before = kinds[i], configs
                configs = _step(g, before, k, i, spans)
            q, u = configs[0]
            break
        i += 1
    return True, n, spans
