"""Cheapest repair of a conversation's rows as min-plus transfer matrices over a grammar of recurring row sequences.

A row is one symbol: s, u, a, o (role system, user, assistant, other), in capitals if it is truncated, D if it must be
deleted.  Its matrix holds, for each two states of the role order ``(s?(ua)+)?``, the least cost and the ASCII-least audit
of the edits that lead from one to the other.  Products of matrices are associative; equally cheap audits of the same rows
are never prefixes of one another (an insertion more costs more), so the least stays the least whatever follows.

``recompress`` rules (Re-Pair) name pairs of symbols that recur; each rule has one matrix, made of its two parts' ones,
and every conversation that holds the rule shares it.  Audits are ropes: short text, or (left, right, length)."""

from __future__ import annotations

from itertools import zip_longest

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a role's initial, where the role order allows it.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Symbols of rules, from this code point on.
FIRST_RULE = 0xE000
SHORT = 64

Rope = str | tuple
Matrix = dict  # (state, state) -> (cost, rope)


def length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def joined(a: Rope, b: Rope) -> Rope:
    n = length(a) + length(b)
    if n <= SHORT and isinstance(a, str) and isinstance(b, str):
        return a + b
    return a if not length(b) else b if not length(a) else (a, b, n)


def leaves(rope: Rope):
    left = [rope]
    while left:
        r = left.pop()
        if isinstance(r, str):
            yield r
        else:
            left += [r[1], r[0]]


def text(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def less(a: Rope, b: Rope) -> bool:
    """Whether ``a`` comes before ``b`` in ASCII order, compared leaf by leaf."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    if a is b:
        return False
    x = y = ""
    one, two = leaves(a), leaves(b)
    while True:
        x, y = x or next(one, ""), y or next(two, "")
        n = min(len(x), len(y))
        if not n:
            return not x and bool(y) and any(leaves(b))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def better(a: tuple, b: tuple | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and less(a[1], b[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, r), (c1, t1) in a.items():
        for q in STATES:
            if (e := b.get((r, q))) is not None:
                old = out.get((p, q))
                if old is None or c1 + e[0] <= old[0]:
                    new = (c1 + e[0], joined(t1, e[1]))
                    if better(new, old):
                        out[p, q] = new
    return out


#: Rows inserted between two rows: the fewest that lead from state to state.
INSERTS: Matrix = {(p, p): (0, "") for p in STATES} | {(START, USER): (INSERT, "I"), (SYSTEM, USER): (INSERT, "I"), (USER, ASSISTANT): (INSERT, "I"), (ASSISTANT, USER): (INSERT, "I"),
                                                       (START, ASSISTANT): (2 * INSERT, "II"), (SYSTEM, ASSISTANT): (2 * INSERT, "II")}
CLOSING: Matrix = {(p, q): e for (p, q), e in INSERTS.items() if q in ENDS}


def row_matrix(symbol: str) -> Matrix:
    """Insertions before a row, then its own edit."""
    own: Matrix = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != "D":
        more = TRUNCATED if symbol.isupper() else 0
        for (p, initial), q in NEXT.items():
            if initial != "s":
                own[p, q] = (REROLE + more, "R")
        for (p, initial), q in NEXT.items():
            if initial == symbol.lower():
                own[p, q] = (more, "K")
    return times(INSERTS, own)


class Repairs:
    """Matrices of symbols, made when first met; ``rules``: for each rule its two symbols."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices: dict[str, Matrix] = {}

    def compressed(self, rows: str) -> str:
        for k, pair in enumerate(self.rules):
            if pair in rows:
                rows = rows.replace(pair, chr(FIRST_RULE + k))
        return rows

    def matrix(self, symbol: str) -> Matrix:
        got = self.matrices.get(symbol)
        if got is None:
            k = ord(symbol) - FIRST_RULE
            got = row_matrix(symbol) if k < 0 else times(self.matrix(self.rules[k][0]), self.matrix(self.rules[k][1]))
            self.matrices[symbol] = got
        return got

    def product(self, rows: str) -> Matrix:
        """The matrix of a sequence of rows, by halves."""
        level = [self.matrix(s) for s in self.compressed(rows)]
        if not level:
            return {(p, p): (0, "") for p in STATES}
        while len(level) > 1:
            level = [a if b is None else times(a, b) for a, b in zip_longest(level[::2], level[1::2])]
        return level[0]


def best(matrices: list[Matrix]) -> tuple[int, list[int], list[str]]:
    """Cost, the state before each part and each part's audit (the last one with closing insertions) of the cheapest repair
    of consecutive parts."""
    at: dict = {START: (0, "", ())}
    for m in [*matrices[:-1], times(matrices[-1], CLOSING)]:
        new: dict = {}
        for p, (cost, audit, path) in at.items():
            for q in STATES:
                if (e := m.get((p, q))) is not None:
                    found = (cost + e[0], joined(audit, e[1]), (path, p, e[1]))
                    if better(found, new.get(q)):
                        new[q] = found
        at = new
    cost, path = None, None
    for found in at.values():
        if cost is None or better(found, cost):
            cost, path = found, found[2]
    states, audits = [], []
    while path:
        path, p, audit = path
        states.append(p)
        audits.append(text(audit))
    return cost[0], states[::-1], audits[::-1]


def applied(state: int, audit: str, rows):
    """The repaired (role, text) of rows (role, text, copies), by the edits ``audit`` from ``state`` on."""
    at = 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at += 1
            state = NEXT[state, "a" if state == USER else "u"]
            yield ("assistant" if state == ASSISTANT else "user"), ""

    for role, words, copies in rows:
        for _ in range(copies):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = NEXT[state, "a" if state == USER else "u"]
                yield ("assistant" if state == ASSISTANT else "user"), words
            elif edit == "K":
                state = NEXT[state, role[:1]]
                yield role, words
    yield from inserted()
