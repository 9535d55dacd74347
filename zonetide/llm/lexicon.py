"""A minimal acyclic transducer from words (bytes) to sequences of token ids.

Words that end alike share states. The outputs are numbered by the order of the words: each edge holds how many
words come before those behind it, so the sum along a word's path is its number. All of it is a
few arrays that are memory-mapped from one file.
"""

from __future__ import annotations

import io
import tempfile

import numpy as np

_PARTS = ("edge_keys", "edge_to", "edge_skip", "final", "offsets", "ids")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Contents of a lexicon file. Built in the order of the words: states of a word that the next
    word doesn't share can't change any more and are merged with equal ones."""
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # final, edges (byte, state)
    path: list[list] = [[False, []]]  # open states: final, edges; the last edge is open
    previous = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            signature = (final, tuple(edges))
            number = registry.get(signature)
            if number is None:
                number = registry[signature] = len(states)
                states.append((final, edges))
            path[-1][1].append((byte_of[len(path)], number))

    byte_of: dict[int, int] = {}
    words = sorted(word for word in entries if word)
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common)
        for depth in range(common, len(word)):
            byte_of[depth + 1] = word[depth]
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    root = len(states)
    states.append((path[0][0], path[0][1]))

    below: list[int] = []  # words from each state on; targets have smaller numbers
    keys, to, skip = [], [], []
    for number, (final, edges) in enumerate(states):
        count = int(final)
        for byte, target in edges:
            keys.append((root - number) << 8 | byte)  # the first state is the root
            to.append(root - target)
            skip.append(count)
            count += below[target]
        below.append(count)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    lengths = [len(entries[word]) for word in words]
    arrays = {
        "edge_keys": np.array(keys, np.int64)[order].astype(np.uint32),
        "edge_to": np.array(to, np.uint32)[order], "edge_skip": np.array(skip, np.uint32)[order],
        "final": np.array([final for final, _ in reversed(states)], bool),
        "offsets": np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))),
        "ids": np.array([i for word in words for i in entries[word]], np.uint32)}
    out = io.BytesIO()
    for part in _PARTS:
        array = arrays[part]
        out.write(f"{array.dtype.str} {len(array)}".encode().ljust(32))
        out.write(array.tobytes())
        out.write(b"\0" * (-out.tell() % 32))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, memory-mapped from a file that is gone when the process ends."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            data = np.memmap(file, np.uint8, "r")
        at = 0
        for part in _PARTS:
            kind, size = data[at:at + 32].tobytes().split()
            array = np.frombuffer(data, np.dtype(kind.decode()), int(size), at + 32)
            setattr(self, part, array)
            at += 32 + array.nbytes
            at += -at % 32

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word ``data[start:end]``, -1 for words not in the lexicon. All
        words go forward together, a byte at a time."""
        result = np.full(len(starts), -1, np.int64)
        if not len(self.edge_keys):
            return result
        alive, state = np.flatnonzero(ends > starts), np.zeros(len(starts), np.int64)
        number, at = np.zeros(len(starts), np.int64), starts.astype(np.int64)
        while len(alive):
            key = (state[alive] << 8 | data[at[alive]]).astype(np.uint32)
            edge = np.searchsorted(self.edge_keys, key)
            edge[edge == len(self.edge_keys)] = 0
            there = self.edge_keys[edge] == key
            alive, edge = alive[there], edge[there]
            state[alive] = self.edge_to[edge]
            number[alive] += self.edge_skip[edge]
            at[alive] += 1
            ended = at[alive] == ends[alive]
            done = alive[ended]
            done = done[self.final[state[done]]]
            result[done] = number[done]
            alive = alive[~ended]
        return result

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number]:self.offsets[number + 1]]
