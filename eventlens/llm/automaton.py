"""Deterministic automata over bytes: patterns are compiled by subset
construction, several rules are combined into one automaton, which is minimised
into a transition array.

Patterns are ASCII: literals, ``\\xNN`` and other escaped characters, classes
``[a-z0-9_]`` (no negation), groups, ``|``, ``?``, ``*``, ``+``, ``{m,}``.

A ``Search`` finds the leftmost, longest, non-overlapping matches of every rule
in one pass over the bytes.  A rule is a head followed by a repeated class, so
a match, once accepted, goes on until the class ends.  Each rule keeps its open
attempts in the order of their starts; when the oldest one accepts, the younger
ones are dropped and no attempt starts until the match has ended.  A compiled
rule whose younger attempt could accept before an older one is refused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Byte pattern 256 places wide -> positions; -1 stands for the end of a text.
END = 256


class _Parser:
    """Pattern -> position automaton (Glushkov): ``sets[p]`` the bytes that
    position p reads, ``first``/``last`` positions, ``follow[p]``, ``empty``."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.text, self.at, self.fold = pattern, 0, ignore_case
        self.sets: list[frozenset[int]] = []
        self.follow: list[list[int]] = []
        self.first, self.last, self.empty = self._either()
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.at}")

    def _peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def _either(self):
        first, last, empty = self._row()
        while self._peek() == "|":
            self.at += 1
            f, l, e = self._row()
            first, last, empty = first + f, last + l, empty or e
        return first, last, empty

    def _row(self):
        first, last, empty = [], [], True
        while self._peek() not in ("", "|", ")"):
            f, l, e = self._repeated()
            self._link(last, f)
            first = first + f if empty else first
            last = l + last if e else l
            empty = empty and e
        return first, last, empty

    def _link(self, ends: list[int], starts: list[int]) -> None:
        for p in ends:
            self.follow[p] += [q for q in starts if q not in self.follow[p]]

    def _repeated(self):
        start = self.at
        first, last, empty = self._atom()
        mark = self._peek()
        if mark and mark in "?*+":
            self.at += 1
            if mark in "*+":
                self._link(last, first)
            return first, last, empty or mark in "?*"
        if mark == "{":
            end = self.text.index(",}", self.at)
            least, stop = int(self.text[self.at + 1:end]), end + 2
            atom = self.text[start:self.at]
            for _ in range(least - 1):   # least copies, the last one repeated
                self.at = start
                f, l, e = self._atom()
                self._link(last, f)
                first = first + f if empty else first
                last, empty = (l + last if e else l), empty and e
                final = f, l
            if least == 1:
                final = first, last
            self._link(final[1], final[0])
            assert self.text[start:self.at] == atom
            self.at = stop
        return first, last, empty

    def _atom(self):
        mark = self._peek()
        if mark == "(":
            self.at += 1
            out = self._either()
            if self._peek() != ")":
                raise ValueError(f"group without end in {self.text!r}")
            self.at += 1
            return out
        reads = self._class() if mark == "[" else {self._char()}
        if self.fold:
            reads |= {b ^ 32 for b in reads if chr(b).isalpha()}
        self.sets.append(frozenset(reads))
        self.follow.append([])
        p = len(self.sets) - 1
        return [p], [p], False

    def _char(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2:self.at], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} is not supported")
        if not c or ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def _class(self) -> set[int]:
        self.at += 1
        if self._peek() == "^":
            raise ValueError("negated classes are not supported")
        out: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.at += 1
                high = self._char()
            out |= set(range(low, high + 1))
        self.at += 1
        return out


def _subsets(start: tuple, step: Callable, symbols: int) -> tuple[list[tuple], np.ndarray]:
    """All states reachable from ``start`` and their transition array."""
    states, number, rows = [start], {start: 0}, []
    for state in states:
        row = []
        for c in range(symbols):
            to = step(state, c)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        rows.append(row)
    return states, np.array(rows, np.int64)


def _minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart, by refining the partition
    by ``marks``; state 0 stays the start."""
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        seen, inverse = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        inverse = inverse.ravel()
        if len(seen) == len(np.unique(part)):
            break
        part = inverse
    _, at, inverse = np.unique(part, return_index=True, return_inverse=True)
    order = np.argsort(at)                      # parts in the order of their first state
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[inverse.ravel()][table[at[order]]], marks[at[order]]


def _byte_classes(sets: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Class of every byte (bytes that all sets treat alike share one) and one
    byte of each class."""
    member = np.array([[b in s for s in sets] for b in range(256)], bool).reshape(256, len(sets))
    _, at, inverse = np.unique(member, axis=0, return_index=True, return_inverse=True)
    return inverse.ravel().astype(np.uint8), at.tolist()


class Matcher:
    """Anchored automaton of one pattern: the longest match from the beginning
    of some bytes; ``backwards`` reads them from their end."""

    def __init__(self, pattern: str, ignore_case: bool = False, backwards: bool = False):
        p = _Parser(pattern, ignore_case)
        first, last, follow = p.first, p.last, p.follow
        if backwards:
            first, last = last, first
            follow = [[q for q in range(len(p.sets)) if r in p.follow[q]] for r in range(len(p.sets))]
        classes, sample = _byte_classes(p.sets)

        def step(state, c):
            found = {q for r in state for q in (first if r < 0 else follow[r]) if sample[c] in p.sets[q]}
            return tuple(sorted(found))
        states, table = _subsets((-1,), step, len(sample))
        accept = np.array([p.empty if s == (-1,) else bool(set(s) & set(last)) for s in states])
        dead = [i for i, s in enumerate(states) if not s]
        self.rows = [[int(table[s, c]) for c in classes] for s in range(len(states))]
        self.accept, self.dead = accept.tolist(), dead[0] if dead else -1

    def longest(self, data) -> int:
        """Length of the longest match, or -1; ``data`` in reading order."""
        state, best = 0, 0 if self.accept[0] else -1
        for i, b in enumerate(data, 1):
            state = self.rows[state][b]
            if state == self.dead:
                break
            if self.accept[state]:
                best = i
        return best


class Search:
    """All rules (pattern, ignore_case) as one minimised automaton.  ``table``:
    states x byte classes (the last class ends a text); ``marks[s]``: a bit per
    rule that is inside an accepted match in state s."""

    #: Lanes in which a run of bytes is scanned side by side, and the rounds
    #: after which lanes that still disagree are walked one after the other.
    LANE, ROUNDS = 256, 3

    def __init__(self, rules: list[tuple[str, bool]]):
        parsed = [_Parser(pattern, fold) for pattern, fold in rules]
        classes, sample = _byte_classes([s for p in parsed for s in p.sets])
        symbols = len(sample) + 1

        def attempts(p: _Parser, state: tuple, byte: int) -> tuple:
            """Open attempts of one rule after a byte, oldest first."""
            found = [q for r in state for q in p.follow[r] if byte in p.sets[q]]
            if not found or found[0] not in p.last:
                found += [q for q in p.first if byte in p.sets[q]]
            found = list(dict.fromkeys(found))
            if found and found[0] in p.last:
                return tuple(found[:1])
            if any(q in p.last for q in found):
                raise ValueError("a younger attempt accepts before an older one")
            return tuple(found)

        def step(state: tuple, c: int) -> tuple:
            if c == symbols - 1:
                return tuple(() for _ in parsed)
            return tuple(attempts(p, s, sample[c]) for p, s in zip(parsed, state))

        for p in parsed:
            if any(q in p.last for q in p.first) or any(q not in p.last for r in p.last for q in p.follow[r]):
                raise ValueError("a rule is a head and a repeated class")
        states, table = _subsets(tuple(() for _ in parsed), step, symbols)
        marks = np.array([sum(1 << i for i, (p, s) in enumerate(zip(parsed, state)) if s and s[0] in p.last)
                          for state in states], np.uint8)
        self.table, self.marks = _minimised(table, marks)
        self.symbols, self.rules = symbols, len(rules)
        self.classes = np.append(classes, np.uint8(symbols - 1))
        self.flat = (self.table * symbols).astype(np.int32).ravel()      # states premultiplied
        self.steps = self.flat.tolist()

    def states(self, text_classes: np.ndarray) -> np.ndarray:
        """State after every byte.  All lanes are first scanned from the start
        state, side by side; a lane whose predecessor ended in another state is
        scanned again from there.  Texts bring the automaton back to its start
        within a few bytes, so few lanes take part in a second round."""
        n = len(text_classes)
        lanes = -(-n // self.LANE)
        padded = np.full(lanes * self.LANE, self.symbols - 1, np.uint8)
        padded[:n] = text_classes
        columns = np.ascontiguousarray(padded.reshape(lanes, self.LANE).T)
        out = np.empty(columns.shape, np.int32)
        start = np.zeros(lanes, np.int32)
        todo, rounds = np.arange(lanes), 0
        while len(todo) and rounds < self.ROUNDS:
            state = start[todo]
            some = columns if len(todo) == lanes else columns[:, todo]
            for i in range(self.LANE):
                state = self.flat[state + some[i]]
                out[i, todo] = state
            true = np.append(np.int32(0), out[-1, :-1])
            todo = np.flatnonzero(true != start)
            start = true
            rounds += 1
        for lane in todo.tolist():
            self._walk(columns, out, lane)
        return out.T.reshape(-1)[:n] // self.symbols

    def _walk(self, columns: np.ndarray, out: np.ndarray, lane: int) -> None:
        """Correct one lane, and those after it as far as they change."""
        flat = self.steps
        state = int(out[-1, lane - 1])
        while lane < out.shape[1]:
            old, new = out[:, lane].tolist(), []
            for was, c in zip(old, columns[:, lane].tolist()):
                state = flat[state + c]
                if state == was:
                    break
                new.append(state)
            out[:len(new), lane] = new
            if len(new) < len(old):
                return
            lane += 1

    def ends(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(end, rule) of every match in ``data`` (uint16; END after a text),
        in the order of the ends."""
        inside = self.marks[self.states(self.classes[data])]
        change = np.flatnonzero(inside[:-1] & ~inside[1:]) if len(inside) else []
        return [(int(i) + 1, r) for i in change for r in range(self.rules) if (inside[i] & ~inside[i + 1]) >> r & 1]
