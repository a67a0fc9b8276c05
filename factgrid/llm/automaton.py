"""One deterministic automaton for many rules: subset construction, minimisation, and scans over many texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Node = tuple
#: (pattern, group that is measured or 0 for the whole match, its least length, whether letters match in either case).
Rule = tuple[str, int, int, bool]


def parse(pattern: str) -> Node:
    """A rule as a tree: ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None), ("group", number, node).

    Rules are made of literals, escapes (\\xHH, or a mark after a backslash), classes with ranges, groups, |, ?, *, + and {n,}.
    """
    at, groups = 0, 0

    def char() -> int:
        nonlocal at
        if pattern[at] == "\\":
            at += 1
            if pattern[at] == "x":
                at += 3
                return int(pattern[at - 2 : at], 16)
            if pattern[at].isalnum():
                raise ValueError(f"not in rules: \\{pattern[at]}")
        at += 1
        return ord(pattern[at - 1])

    def atom() -> Node:
        nonlocal at, groups
        if pattern[at] == "(":
            at, groups = at + 1, groups + 1
            number = groups
            inner = ways()
            at += 1
            return "group", number, inner
        if pattern[at] == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                chars.update(range(low, high + 1))
            at += 1
            return "set", frozenset(chars)
        if pattern[at] in ".^$":
            raise ValueError(f"not in rules: {pattern[at]}")
        return "set", frozenset({char()})

    def row() -> Node:
        nonlocal at
        nodes = []
        while at < len(pattern) and pattern[at] not in "|)":
            node = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index(",}", at)
                    node, at = ("rep", node, int(pattern[at + 1 : end]), None), end + 2
                else:
                    node, at = ("rep", node, int(pattern[at] == "+"), 1 if pattern[at] == "?" else None), at + 1
            nodes.append(node)
        return "cat", nodes

    def ways() -> Node:
        nonlocal at
        nodes = [row()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            nodes.append(row())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    tree = ways()
    if at < len(pattern):
        raise ValueError(f"not in rules: {pattern[at:]}")
    return tree


def shortest(node: Node) -> int:
    kind = node[0]
    if kind == "set":
        return 1
    if kind == "rep":
        return node[2] * shortest(node[1])
    if kind == "group":
        return shortest(node[2])
    return sum(map(shortest, node[1])) if kind == "cat" else min(map(shortest, node[1]))


def lengthened(tree: Node, group: int, least: int) -> Node:
    """The tree for matches whose group has the least length: its last repeated set is repeated so often.

    The rest of the group has to be of one length, as in all rules here.
    """

    def grown(node: Node, by: int) -> Node:
        if node[0] == "cat":
            return "cat", [*node[1][:-1], grown(node[1][-1], by)]
        if node[0] == "rep" and node[3] is None and node[1][0] == "set":
            return "rep", node[1], node[2] + by, None
        raise ValueError("a measured group ends in a repeated set")

    def walk(node: Node) -> Node:
        if node[0] == "group":
            return (*node[:2], grown(node[2], max(0, least - shortest(node[2]))) if node[1] == group else walk(node[2]))
        if node[0] in ("cat", "alt"):
            return node[0], [walk(x) for x in node[1]]
        return (node[0], walk(node[1]), *node[2:]) if node[0] == "rep" else node

    if not least:
        return tree
    return walk(tree) if group else grown(tree, max(0, least - shortest(tree)))


class Nfa:
    """steps[s]: (set of bytes, or None for none, next state); ends[s]: the marks of rules that end there."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset[int] | None, int]]] = [[]]
        self.ends: dict[int, int] = {}

    def new(self) -> int:
        self.steps.append([])
        return len(self.steps) - 1

    def add(self, node: Node, at: int, any_case: bool) -> int:
        """The tree from state `at` on; returns where it ends."""
        kind = node[0]
        if kind == "set":
            chars = node[1]
            if any_case:
                chars = chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
            end = self.new()
            self.steps[at].append((chars, end))
            return end
        if kind == "cat":
            for x in node[1]:
                at = self.add(x, at, any_case)
            return at
        if kind == "alt":
            end = self.new()
            for x in node[1]:
                self.steps[self.add(x, at, any_case)].append((None, end))
            return end
        if kind == "group":
            return self.add(node[2], at, any_case)
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at, any_case)
        end = self.new()
        self.steps[at].append((None, end))
        if high is None:
            self.steps[self.add(inner, end, any_case)].append((None, end))
        else:
            for _ in range(high - low):
                at = self.add(inner, at, any_case)
                self.steps[at].append((None, end))
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for chars, t in self.steps[todo.pop()]:
                if chars is None and t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def determined(self, anywhere: bool, mark: Callable[[int], int]) -> tuple[np.ndarray, np.ndarray]:
        """(table, marks) by subset construction: state 0 is the start; mark turns the marks of a state's rules into its own.

        anywhere: a match may begin at any byte, and a state with a mark is never left. Else a dead state is one of no NFA states.
        """
        start = self.closed({0})
        again = start if anywhere else frozenset()
        number, order, rows, marks = {start: 0}, [start], [], []
        for states in order:
            marks.append(mark(sum({self.ends[s] for s in states & self.ends.keys()})))
            row = np.full(256, -1, np.int64)
            if not (anywhere and marks[-1]):
                sets: dict[int, set[int]] = {}
                for s in states:
                    for chars, t in self.steps[s]:
                        for b in chars or ():
                            sets.setdefault(b, set()).add(t)
                to: dict[frozenset[int], int] = {}  # bytes that act alike are followed once
                for b in range(256):
                    key = frozenset(sets.get(b, ()))
                    if key not in to:
                        closed = self.closed(set(key)) | again
                        if closed not in number:
                            number[closed] = len(order)
                            order.append(closed)
                        to[key] = number[closed]
                    row[b] = to[key]
            rows.append(row)
        table = np.array(rows)
        own = np.arange(len(table))[:, None]
        return minimised(np.where(table < 0, own, table), np.array(marks))


def minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits classes of states until no state differs from its class in where a byte leads; bytes that act alike count once."""
    columns = np.unique(table, axis=1)
    group = np.unique(marks, return_inverse=True)[1]
    while True:
        kinds: dict[bytes, int] = {}
        seen = np.column_stack([group, group[columns]])
        refined = np.array([kinds.setdefault(row.tobytes(), len(kinds)) for row in seen])
        if len(kinds) == group.max() + 1:
            break
        group = refined
    first = {g: i for i, g in reversed(list(enumerate(group)))}
    names = {g: k for k, g in enumerate(sorted(first, key=first.get))}  # the start is 0
    keep = [first[g] for g in sorted(first, key=first.get)]
    renamed = np.array([names[g] for g in group])
    return renamed[table[keep]].astype(np.int32), marks[keep]


class Automaton:
    """All rules in transition arrays: one that finds which stretches hold a passing match, and one that gives the matches.

    search[state, byte] is the next state, `hit` the state once a passing match of any rule has been seen, 0 the start. resets[byte]
    marks bytes that lead every other state to the start, so no match spans them. From where a match may begin, spans[state, byte] follows
    all rules together; marks[state] has, for rule r, bit 2r if it ends there and bit 2r + 1 if it passes (the group is long enough).
    """

    def __init__(self, rules: list[Rule]):
        found, each = Nfa(), Nfa()
        for r, (pattern, group, least, any_case) in enumerate(rules):
            tree = parse(pattern)
            longer = lengthened(tree, group, least)
            found.ends[found.add(longer, 0, any_case)] = 1
            each.ends[each.add(tree, 0, any_case)] = 1 << 2 * r
            each.ends[each.add(longer, 0, any_case)] = 2 << 2 * r
        self.n = len(rules)
        self.search, passed = found.determined(True, lambda m: min(m, 1))
        self.hit = int(np.flatnonzero(passed)[0])
        others = np.arange(len(self.search)) != self.hit
        self.resets = (self.search[others] == 0).all(0)
        self.flat = self.search.ravel().astype(np.uint32) << 8  # next state, ready to be joined with a byte
        self.shortest = self._shortest()
        self.spans, marks = each.determined(False, lambda m: m)
        self.marks = marks.tolist()
        self.alive = self._alive()
        self.next = self.spans.tolist()

    def _shortest(self) -> int:
        seen, wave, n = {0}, {0}, 0
        while self.hit not in wave:
            wave = {int(t) for s in wave for t in self.search[s]} - seen
            seen |= wave
            n += 1
        return n

    def _alive(self) -> list[int]:
        """For each state, bit r if rule r may still end further on."""
        rules = np.array([sum(1 << r for r in range(self.n) if m >> 2 * r & 1) for m in self.marks], np.int64)
        to, alive = np.zeros_like(rules), rules * 0
        while True:
            to = np.bitwise_or.reduce((rules | alive)[self.spans], axis=1)
            if (to == alive).all():
                return alive.tolist()
            alive = to

    def stretches(self, data: bytes) -> list[tuple[int, int]]:
        """(start, end) of the stretches between reset bytes that hold a passing match; each byte is looked at once."""
        a = np.frombuffer(data, np.uint8)
        cut = np.flatnonzero(self.resets[a])
        starts = np.concatenate([[0], cut + 1])
        sizes = np.concatenate([cut, [len(a)]]) - starts
        keep = sizes >= self.shortest
        starts, sizes = starts[keep], sizes[keep]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state = np.zeros(len(starts), np.uint32)
        # lanes: stretches side by side, the longest first; lane k ends after sizes[k] bytes
        alive, i = len(starts), 0
        live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for alive in live:
            if alive < 16:
                break
            state[:alive] = self.flat[state[:alive] | a[starts[:alive] + i]]
            i += 1
        else:
            alive = 0
        for k in range(alive):  # the few that are much longer than the rest, one by one
            s, table = int(state[k]), self._lists()
            for b in data[starts[k] + i : starts[k] + sizes[k]]:
                s = table[s | b]
            state[k] = s
        found = np.flatnonzero(state == self.hit << 8)
        return sorted(zip(starts[found].tolist(), (starts[found] + sizes[found]).tolist()))

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the passing matches in a stretch, leftmost, longest and non-overlapping for each rule.

        All rules are followed together from each byte where one may begin, no further than a rule lives that may begin there; what is
        too short takes its bytes, too.
        """
        free, out, rules = [0] * self.n, [], range(self.n)
        for i, b in enumerate(data):
            state = self.next[0][b]
            wanted = sum(1 << r for r in rules if free[r] <= i)
            ends: dict[int, tuple[int, int]] = {}
            j = i + 1
            while True:
                if m := self.marks[state]:
                    for r in rules:
                        if m >> 2 * r & 1:
                            ends[r] = j, m >> 2 * r & 2
                if not self.alive[state] & wanted or j == len(data):
                    break
                state = self.next[state][data[j]]
                j += 1
            for r, (end, passes) in ends.items():
                if free[r] <= i:
                    free[r] = end
                    if passes:
                        out.append((i, r, end))
        return out

    def _lists(self) -> list[int]:
        if not hasattr(self, "as_list"):
            self.as_list = self.flat.tolist()
        return self.as_list
