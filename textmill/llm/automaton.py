"""Minimal deterministic automata over bytes, compiled from regular expressions.

The expressions have literals, escapes (``\\.``, ``\\xHH``), classes of ASCII characters,
groups, ``|`` and the quantifiers ``? * + {m} {m,} {m,n}``. They become one automaton by
Thompson's construction, the subset construction and minimisation by partition
refinement. Bytes that no expression tells apart share a column of the transition array.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np

#: Below this many texts side by side, stepping through each alone is faster.
FEW_LANES = 24


class _Parser:
    """Expression to a tree of ``("set", bytes) | ("cat", nodes) | ("or", nodes) | ("rep", node, low, high)``."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"the expression ends early: {self.text}")
        self.at += 1
        return self.text[self.at - 1]

    def parse(self) -> tuple:
        node = self._either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self._peek()!r} in {self.text}")
        return node

    def _either(self) -> tuple:
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._atom()))
        return ("cat", parts)

    def _repeated(self, node: tuple) -> tuple:
        sign = self._peek()
        if sign in ("?", "*", "+") and sign:
            self.at += 1
            return ("rep", node, int(sign == "+"), 1 if sign == "?" else None)
        if sign == "{":
            close = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : close].partition(",")
            self.at = close + 1
            return ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
        return node

    def _atom(self) -> tuple:
        char = self._take()
        if char == "(":
            node = self._either()
            if self._take() != ")":
                raise ValueError(f"a group is not closed in {self.text}")
            return node
        if char == "[":
            return ("set", self._members())
        return ("set", frozenset([self._code(char)]))

    def _code(self, char: str) -> int:
        if char == "\\":
            char = self._take()
            if char == "x":
                code = int(self._take() + self._take(), 16)
                char = chr(code)
            elif char in string.ascii_letters + string.digits:
                raise ValueError(f"unknown escape \\{char} in {self.text}")
        if ord(char) > 127:
            raise ValueError(f"expressions are ASCII: {self.text}")
        return ord(char)

    def _members(self) -> frozenset[int]:
        if self._peek() == "^":
            raise ValueError(f"classes name what they hold: {self.text}")
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._code(self._take())
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._code(self._take())
            found.update(range(low, high + 1))
        self.at += 1
        return frozenset(found)


def _backward(node: tuple) -> tuple:
    """The expression of the reversed strings."""
    if node[0] == "cat":
        return ("cat", [_backward(n) for n in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_backward(n) for n in node[1]])
    if node[0] == "rep":
        return ("rep", _backward(node[1]), *node[2:])
    return node


class _Fragments:
    """States with silent steps and steps by sets of bytes."""

    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.silent.append([])
        self.step.append(None)
        return len(self.step) - 1

    def add(self, node: tuple, start: int) -> int:
        """Append the states of ``node`` behind ``start``; its last state."""
        if node[0] == "set":
            end = self.state()
            last = self.state()
            self.silent[start].append(end)
            self.step[end] = (node[1], last)
            return last
        if node[0] == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if node[0] == "or":
            ends = [self.add(part, self._after(start)) for part in node[1]]
            last = self.state()
            for end in ends:
                self.silent[end].append(last)
            return last
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self._after(start)
            self.silent[self.add(inner, loop)].append(loop)
            return self._after(loop)
        last = self.state()
        self.silent[start].append(last)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.silent[start].append(last)
        return last

    def _after(self, start: int) -> int:
        new = self.state()
        self.silent[start].append(new)
        return new

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.silent[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``moves[state, column]`` are the next states; bit ``r`` of ``accept`` tells that expression ``r`` ends here."""

    column: np.ndarray
    moves: np.ndarray
    accept: np.ndarray
    used: np.ndarray

    @property
    def rows(self) -> list[list[int]]:
        """The transitions of each state by byte, as lists."""
        return self.moves[:, self.column].tolist()

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which expressions end anywhere in each span of ``data``, as bits.

        The spans advance side by side, a byte a step; the last few long ones go on alone.
        """
        width = self.moves.shape[1]
        ahead = (self.moves * width).reshape(-1)
        accept = np.repeat(self.accept, width)
        order = np.argsort(starts - ends, kind="stable")
        place, length = starts[order], (ends - starts)[order]
        column = self.column[data]
        state = np.zeros(len(order), np.int64)
        bits = np.zeros(len(order), np.uint32)
        lanes, step = len(order), 0
        while lanes:
            lanes = int(np.searchsorted(-length[:lanes], -step))
            if lanes < FEW_LANES:
                break
            now = ahead[state[:lanes] + column[place[:lanes] + step]]
            state[:lanes] = now
            bits[:lanes] |= accept[now]
            step += 1
        if lanes:
            rows, marks = self.rows, self.accept.tolist()
            for lane in range(lanes):
                at, seen = int(state[lane]) // width, int(bits[lane])
                for byte in data[place[lane] + step : place[lane] + length[lane]].tobytes():
                    at = rows[at][byte]
                    seen |= marks[at]
                bits[lane] = seen
        out = np.empty(len(order), np.uint32)
        out[order] = bits
        return out


def _minimal(moves: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no string tells apart: parts are split by their moves until none splits."""
    part = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.full(part.max() + 1, -1)
    first[part[::-1]] = np.arange(len(part))[::-1]
    # The part of the first state becomes state 0.
    order = np.concatenate(([part[0]], np.delete(np.arange(len(first)), part[0])))
    number = np.empty(len(first), np.int64)
    number[order] = np.arange(len(first))
    return number[part[moves[first[order]]]], accept[first[order]]


def compiled(expressions: list[str], search: bool = False, backward: bool = False) -> Automaton:
    """One automaton for all expressions.

    With ``search`` a match may begin at any byte, otherwise only at the first. With
    ``backward`` it reads strings from their end.
    """
    if len(expressions) > 32:
        raise ValueError("an automaton tells at most 32 expressions apart")
    parts = _Fragments()
    start = parts.state()
    final = {}
    for number, text in enumerate(expressions):
        tree = _Parser(text).parse()
        final[parts.add(_backward(tree) if backward else tree, parts._after(start))] = 1 << number
    sets = sorted({s[0] for s in parts.step if s}, key=sorted)
    inside = np.array([[b in s for s in sets] for b in range(256)]).reshape(256, -1)
    kinds, column = np.unique(inside, axis=0, return_inverse=True)
    column = column.reshape(-1)
    sample = [int(np.flatnonzero(column == c)[0]) for c in range(len(kinds))]
    first = parts.closure([start])
    number, todo, moves = {first: 0}, [first], []
    for states in todo:  # grows while it is read
        row = []
        for byte in sample:
            after = [parts.step[s][1] for s in states if parts.step[s] and byte in parts.step[s][0]]
            after = parts.closure([*after, start] if search else after)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        moves.append(row)
    accept = np.array([sum({final[s] for s in states if s in final}) for states in todo], np.uint32)
    moves, accept = _minimal(np.array(moves), accept)
    return Automaton(column.astype(np.int64), moves, accept, inside.any(axis=1))
