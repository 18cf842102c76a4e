"""LR tables of a grammar over roles, and the graph-structured stack that walks them.

Stacks share their tails: a node is a state on a parent node, and equal nodes
are one. What a terminal does to a node is remembered, so a grammar whose
stacks stay shallow is soon a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

#: An optional system turn, then one or more exchanges of user and assistant; or nothing.
CHAT = (("C", ()), ("C", ("B",)), ("B", ("s", "L")), ("B", ("L",)), ("L", ("L", "P")), ("L", ("P",)), ("P", ("u", "a")))
END = "$"
Item = tuple[int, int]


@dataclass
class Grammar:
    """SLR tables of ``productions``; the first left side is the start. Ambiguous cells keep all actions."""

    productions: Sequence[tuple[str, tuple[str, ...]]] = CHAT
    actions: list[dict[str, list[tuple[str, int]]]] = field(default_factory=list)
    gotos: list[dict[str, int]] = field(default_factory=list)

    def __post_init__(self):
        self.rules = [("'", (self.productions[0][0],)), *self.productions]
        self.names = {left for left, _ in self.rules}
        first, empty = self._first()
        follow = self._follow(first, empty)
        states = [self._closed({(0, 0)})]
        for items in states:  # grows while it is walked
            acts: dict[str, list[tuple[str, int]]] = {}
            goes: dict[str, int] = {}
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                moved = self._closed({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == (symbol,)})
                if moved not in states:
                    states.append(moved)
                goes[symbol] = states.index(moved)
                if symbol not in self.names:
                    acts.setdefault(symbol, []).append(("shift", goes[symbol]))
            for r, d in sorted(items):
                if d == len(self.rules[r][1]):
                    for after in sorted(follow[self.rules[r][0]]):
                        acts.setdefault(after, []).append(("accept" if r == 0 else "reduce", r))
            self.actions.append(acts)
            self.gotos.append(goes)

    def _closed(self, items: set[Item]) -> frozenset[Item]:
        found, todo = set(items), list(items)
        while todo:
            r, d = todo.pop()
            for ahead in self.rules[r][1][d:d + 1]:
                for n, (left, _) in enumerate(self.rules):
                    if left == ahead and (n, 0) not in found:
                        found.add((n, 0))
                        todo.append((n, 0))
        return frozenset(found)

    def _first(self) -> tuple[dict[str, set[str]], set[str]]:
        first: dict[str, set[str]] = {n: set() for n in self.names}
        empty: set[str] = set()
        for _ in self.rules:  # as many rounds as rules are enough
            for left, right in self.rules:
                for symbol in right:
                    first[left] |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                else:
                    empty.add(left)
        return first, empty

    def _follow(self, first: dict[str, set[str]], empty: set[str]) -> dict[str, set[str]]:
        follow: dict[str, set[str]] = {n: set() for n in self.names}
        follow["'"] = {END}
        for _ in self.rules:
            for left, right in self.rules:
                behind = set(follow[left])
                for symbol in reversed(right):
                    if symbol in self.names:
                        follow[symbol] |= behind
                    behind = first.get(symbol, {symbol}) | (behind if symbol in empty else set())
        return follow


class Stacks:
    """Nodes of a graph-structured stack; node 0 holds the first state."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.state, self.parent = [0], [-1]
        self.at: dict[tuple[int, int], int] = {(0, -1): 0}
        self.known: dict[tuple[int, str], tuple[int, ...]] = {}

    def push(self, state: int, parent: int) -> int:
        key = state, parent
        if key not in self.at:
            self.at[key] = len(self.state)
            self.state.append(state)
            self.parent.append(parent)
        return self.at[key]

    def advance(self, node: int, terminal: str) -> tuple[int, ...]:
        """The nodes after shifting ``terminal``; for the end mark, ``node`` itself if it is accepted."""
        key = node, terminal
        if key not in self.known:
            out, seen, todo = set(), {node}, [node]
            while todo:
                now = todo.pop()
                for action, n in self.grammar.actions[self.state[now]].get(terminal, ()):
                    if action == "shift":
                        out.add(self.push(n, now))
                    elif action == "accept":
                        out.add(node)
                    else:
                        left, right = self.grammar.rules[n]
                        base = now
                        for _ in right:
                            base = self.parent[base]
                        reduced = self.push(self.grammar.gotos[self.state[base]][left], base)
                        if reduced not in seen:
                            seen.add(reduced)
                            todo.append(reduced)
            self.known[key] = tuple(sorted(out))
        return self.known[key]
