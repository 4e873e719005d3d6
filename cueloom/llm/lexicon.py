"""A minimal acyclic transducer from words to sequences of ids.

Words with a common beginning share its path and words with a common rest share the states of that rest. Transitions carry
how many words sort before them, so the sum along a word's path is the word's number, and numbers index the id sequences:
the automaton stays minimal although its outputs differ. States are packed by row displacement into flat arrays, which are
read in place from one memory-mapped file; a batch of words is looked up a byte position at a time.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np

#: The flat arrays of the file, in its order.
FIELDS = ("base", "check", "target", "skip", "final", "starts", "ids")


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States (transitions, final) of the minimal automaton of ascending distinct words; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, next) of the last word, not yet minimised
    free: list[int] = []

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte, child = path.pop()
            sign = (final[child], tuple(edges[child].items()))
            if sign in register:
                edges[state][byte] = register[sign]
                edges[child], final[child] = {}, False
                free.append(child)
            else:
                register[sign] = child

    last = b""
    for word in words:
        common = len(os.path.commonprefix((last, word)))
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            if free:
                child = free.pop()
            else:
                child = len(edges)
                edges.append({})
                final.append(False)
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    settle(0)
    return edges, final


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for words (none empty) and their id sequences."""
    words = sorted(entries)
    edges, final = _minimal(words)
    below: dict[int, int] = {}

    def count(root: int) -> None:
        todo = [root]
        while todo:
            state = todo[-1]
            missing = [c for c in edges[state].values() if c not in below]
            if missing:
                todo.extend(missing)
            else:
                below[todo.pop()] = final[state] + sum(below[c] for c in edges[state].values())

    count(0)
    used = sorted(below, key=lambda s: -len(edges[s]))
    size = 256 + 2 * sum(len(edges[s]) for s in used)
    base, taken, free, begin, width = np.zeros(len(edges), dtype=np.int32), bytearray(size + 512), 0, 0, 0
    placed: list[tuple[int, int, int, int]] = []
    for state in used:
        row, before = sorted(edges[state]), int(final[state])
        if len(row) > 1:  # first fit, on from where the last row of this length went
            at = begin if len(row) == width else 0
            while any(taken[at + b] for b in row):
                at += 1
            begin, width = at, len(row)
        elif row:
            while taken[free] or free < row[0]:
                free += 1
            at, free = free - row[0], free if row[0] else free + 1
        else:
            continue
        if at + 1024 > len(taken):
            taken.extend(bytes(len(taken)))
        base[state] = at
        for b in row:
            taken[at + b] = 1
            placed.append((at + b, state, edges[state][b], before))
            before += below[edges[state][b]]
    check, target, skip = (np.full(len(taken), v, dtype=np.int32) for v in (-1, 0, 0))
    if placed:
        slots, owners, targets, skips = np.array(placed, dtype=np.int64).T
        check[slots], target[slots], skip[slots] = owners, targets, skips
    lengths = [len(entries[w]) for w in words]
    arrays = (base, check, target, skip, np.array(final, dtype=np.int32), np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), np.array([i for w in words for i in entries[w]], dtype=np.int32))
    head = np.array([len(a) for a in arrays], dtype="<i8").tobytes()
    return head + b"".join(a.astype("<i4").tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped from a file."""

    def __init__(self, path: str) -> None:
        lengths = np.fromfile(path, dtype="<i8", count=len(FIELDS))
        data, at = np.memmap(path, dtype="<i4", mode="r", offset=8 * len(FIELDS)), 0
        self.arrays = {}
        for name, n in zip(FIELDS, lengths.tolist(), strict=True):
            self.arrays[name] = data[at : at + n]
            at += n

    @classmethod
    def from_bytes(cls, blob: bytes) -> Lexicon:
        """Maps a file of these bytes, which has no name any more: it goes with the process."""
        handle, path = tempfile.mkstemp(prefix="cueloom-lexicon-")
        try:
            with os.fdopen(handle, "wb") as out:
                out.write(blob)
            return cls(path)
        finally:
            os.unlink(path)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word data[start:start+length], or -1."""
        a = self.arrays
        out = np.full(len(starts), -1, dtype=np.int32)
        rows = np.flatnonzero(lengths > 0)
        at, left = starts[rows], lengths[rows]
        state, number = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=np.int32)
        while len(rows):
            slot = a["base"][state] + data[at]
            ok = a["check"][slot] == state
            if not ok.all():
                rows, at, left, number, slot = rows[ok], at[ok], left[ok], number[ok], slot[ok]
            number = number + a["skip"][slot]
            state = a["target"][slot]
            at, left = at + 1, left - 1
            over = left == 0
            if over.any():
                done = over & (a["final"][state] == 1)
                out[rows[done]] = number[done]
                on = ~over
                rows, at, left, number, state = rows[on], at[on], left[on], number[on], state[on]
        return out

    def words(self) -> Iterable[bytes]:
        """All words in order (for tests)."""
        a, todo = self.arrays, [(0, b"")]
        while todo:
            state, word = todo.pop()
            if a["final"][state]:
                yield word
            for b in range(255, -1, -1):
                slot = a["base"][state] + b
                if a["check"][slot] == state:
                    todo.append((int(a["target"][slot]), word + bytes([b])))
