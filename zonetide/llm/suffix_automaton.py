"""Suffix automata: the smallest automata that read every substring of a text."""

from __future__ import annotations

import numpy as np


def suffix_automaton(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, byte, target) of all transitions. State 0 is the start; there are at most ``2 * len(text)`` states."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in text:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and byte not in steps[state]:
            steps[state][byte] = new
            state = link[state]
        if state >= 0:
            old = steps[state][byte]
            if length[old] == length[state] + 1:
                link[new] = old
            else:
                # Shorter strings that end in ``old`` also end here: they get a state of their own.
                twin = len(steps)
                steps.append(dict(steps[old]))
                link.append(link[old])
                length.append(length[state] + 1)
                link[old] = link[new] = twin
                while state >= 0 and steps[state].get(byte) == old:
                    steps[state][byte] = twin
                    state = link[state]
        last = new
    source = np.repeat(np.arange(len(steps), dtype=np.int32), [len(s) for s in steps])
    byte_ = np.fromiter((b for s in steps for b in s), np.uint8, len(source))
    target = np.fromiter((t for s in steps for t in s.values()), np.int32, len(source))
    return source, byte_, target


class Parser:
    """Several automata as one table, to parse many texts at once.

    A text is cut from left to right into phrases, each the longest string that the automaton reads from there on, or
    one byte that it can't read at all. An entry of the table is the next state, negative where a new phrase begins.
    States are numbered by the place of their row, so that a step is one look-up.
    """

    def __init__(self, automata: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ignored: int):
        read = [(s[b != ignored], b[b != ignored], t[b != ignored]) for s, b, t in automata]
        used = np.unique(np.concatenate([b for _, b, _ in read])) if read else np.zeros(0, np.uint8)
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        sizes = [int(max(t.max(initial=0), s.max(initial=0))) + 1 for s, _, t in read]
        first = 1 + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        table = np.zeros((int(first[-1]), width), np.int32)
        for (source, byte, target), at, size in zip(read, first, sizes, strict=False):
            start = np.full(width, at * width, np.int32)
            from_start = source == 0
            start[self.symbol[byte[from_start]]] = (at + target[from_start]) * width
            table[at:at + size] = -start
            later = ~from_start
            table[at + source[later], self.symbol[byte[later]]] = (at + target[later]) * width
        self.table, self.starts = table.ravel(), (first[:-1] * width).astype(np.int32)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of phrases by automaton (rows) and text; texts are stretches of ``symbols``, all parsed side by side,
        one symbol of each at a time."""
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        state = np.repeat(self.starts[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        ending = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for at, active in enumerate(ending.tolist()):
            following = self.table[state[:, :active] + symbols[begin[:active] + at]]
            count[:, :active] += following < 0
            state[:, :active] = np.abs(following)
        out = np.empty_like(count)
        out[:, order] = count
        return out
