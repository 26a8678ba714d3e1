"""Recognising token streams with memoised derivatives of grammars.

A grammar is a set of hash-consed expressions: the empty language, the empty
word, one token, a sequence, a choice, a name, or a bracket that binds the
value of its opening token.  The derivative of an expression by a token is
the language of what may follow that token.  Derivatives are kept by
(expression, token), so a stream costs one table look-up per token once the
states have been seen.

An empty derivative marks the token at which the stream fails; a last
derivative that does not hold the empty word tells a truncated stream.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

NONE, EMPTY = 0, 1
LIMIT = 400_000


class Grammar:
    """``rules`` maps names to bodies built by the constructor methods."""

    def __init__(self) -> None:
        self._build = None
        self._reset()

    def _reset(self) -> None:
        self.nodes: list[tuple] = [("none",), ("empty",)]
        self.ids: dict[tuple, int] = {n: i for i, n in enumerate(self.nodes)}
        self.rules: dict[str, int] = {}
        self.memo: dict[tuple[int, Hashable], int] = {}
        self.null: dict[int, bool] = {NONE: False, EMPTY: True}
        self.names_null: dict[str, bool] = {}

    # -- constructors

    def _node(self, *n) -> int:
        i = self.ids.get(n)
        if i is None:
            i = self.ids[n] = len(self.nodes)
            self.nodes.append(n)
        return i

    def token(self, *kinds: Hashable) -> int:
        return self._node("token", frozenset(kinds))

    def seq(self, *parts: int) -> int:
        out = EMPTY
        for p in reversed(parts):
            out = self._seq2(p, out)
        return out

    def _seq2(self, a: int, b: int) -> int:
        if a == NONE or b == NONE:
            return NONE
        if a == EMPTY:
            return b
        if b == EMPTY:
            return a
        n = self.nodes[a]
        if n[0] == "seq":
            return self._seq2(n[1], self._seq2(n[2], b))
        return self._node("seq", a, b)

    def choice(self, *parts: int) -> int:
        flat: set[int] = set()
        for p in parts:
            n = self.nodes[p]
            flat |= n[1] if n[0] == "choice" else {p}
        flat.discard(NONE)
        if not flat:
            return NONE
        return flat.pop() if len(flat) == 1 else self._node("choice", frozenset(flat))

    def name(self, x: str) -> int:
        return self._node("name", x)

    def bound(self, opens: str, body: int, closes: str) -> int:
        """``(opens, v) body closes`` where the closing token is either bare
        ``(closes, "")`` or names the same ``v``."""
        return self._node("bound", opens, body, closes)

    def define(self, build) -> "Grammar":
        """``build(self)`` fills ``rules`` and returns the start expression;
        it is called again when the tables are forgotten."""
        self._build = build
        self.start = build(self)
        self._fix_nullable()
        return self

    # -- the empty word

    def _fix_nullable(self) -> None:
        self.names_null = dict.fromkeys(self.rules, False)
        changed = True
        while changed:
            changed = False
            for x, body in self.rules.items():
                if not self.names_null[x] and self._null(body, {}):
                    self.names_null[x] = changed = True

    def _null(self, i: int, seen: dict[int, bool]) -> bool:
        n = self.nodes[i]
        kind = n[0]
        if kind == "empty":
            return True
        if kind == "seq":
            return self._null(n[1], seen) and self._null(n[2], seen)
        if kind == "choice":
            return any(self._null(x, seen) for x in n[1])
        return kind == "name" and self.names_null[n[1]]

    def nullable(self, i: int) -> bool:
        # a sequence is as long as the nesting, so its tail is walked in a loop
        while self.nodes[i][0] == "seq":
            if not self._null(self.nodes[i][1], {}):
                return False
            i = self.nodes[i][2]
        return self._null(i, {})

    # -- derivatives

    def derive(self, i: int, t: Hashable) -> int:
        key = (i, t)
        d = self.memo.get(key)
        if d is None:
            d = self.memo[key] = self._derive(i, t)
        return d

    def _derive(self, i: int, t: Hashable) -> int:
        n = self.nodes[i]
        kind = n[0]
        if kind == "token":
            return EMPTY if t in n[1] else NONE
        if kind == "name":
            return self.derive(self.rules[n[1]], t)
        if kind == "choice":
            return self.choice(*[self.derive(x, t) for x in n[1]])
        if kind == "bound":
            if isinstance(t, tuple) and t[0] == n[1]:
                return self.seq(n[2], self.token((n[3], ""), (n[3], t[1])))
            return NONE
        if kind == "seq":
            found = [self._seq2(self.derive(n[1], t), n[2])]
            while self._null(n[1], {}):
                n = self.nodes[n[2]]
                if n[0] != "seq":
                    found.append(self.derive(self.ids[n], t))
                    break
                found.append(self._seq2(self.derive(n[1], t), n[2]))
            return self.choice(*found)
        return NONE

    def recognise(self, tokens: Iterable[Hashable]) -> tuple[str, int]:
        """("ok" | "failed" | "truncated", number of the last token read)."""
        if len(self.nodes) > LIMIT or len(self.memo) > LIMIT:
            self._reset()
            self.start = self._build(self)
            self._fix_nullable()
        state, memo, k = self.start, self.memo, -1
        for k, t in enumerate(tokens):
            following = memo.get((state, t))
            state = self.derive(state, t) if following is None else following
            if state == NONE:
                return "failed", k
        return ("ok" if self.nullable(state) else "truncated"), k
