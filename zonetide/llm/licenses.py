"""License scan by conditional compression.

Blocks are the words round cue words, across line ends. A template's cues are its most telling words, as many as it takes
so that no place with enough of its words can do without all of them; so none is missed, whatever the templates are.

Windows as long as the widest place that a template may fill slide over a block. Each is compressed on its own and
with the template as a raw zstandard dictionary. All windows of all templates are ranked by the bytes that saves, and
taken in this order: where the exact wording confirms the template (enough of its words stand there in order), the place
is found and blanked out, and what differs is reported. What is left is ranked again until nothing is confirmed any more.
Windows that the dictionary doesn't make smaller by a twentieth of what the template takes itself aren't looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import Words, flat, slices, text_of

# Wordings of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                  "software and associated documentation files, to deal in the Software without "
                  "restriction, including without limitation the rights to use, copy, modify, merge, "
                  "publish, distribute, sublicense, and/or sell copies of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
                         "this file except in compliance with the License. You may obtain a copy of the "
                         "License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the "
                      "terms of the GNU General Public License as published by the Free Software "
                      "Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
# Words too common to be cues, unless a template has too few others.
COMMON = frozenset(b"a above an and any as at be by can for from free have if in including is it later may must no not of on "
                   b"or other out set so software such that the their these they this to under use used version was "
                   b"were when with without work you your".split())

LEAST_SAVED = 0.05    # of the template's own compressed size, by which a window gets smaller
LEAST_MATCHED = 0.8   # of the template's words
FILLER = b"\0" * 32   # the compressor looks for matches only where some bytes follow
CACHED_BLOCKS = 20_000

_FOUND = ("start long, end long, license string, rank int, reduction double, matched double, "
          "missing string, added int")


def _compressor(content: bytes | None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=15, chain_log=15,
        search_log=6, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)
    if content is None:
        return zstandard.ZstdCompressor(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(
        content + b"\n" * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def _words(text: bytes) -> Words:
    """The words of one text, whose bytes needn't be valid UTF-8."""
    return Words(pa.Array.from_buffers(pa.large_string(), 1, [
        None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)]))


class Wording:
    """The words of a template, and where they stand in others."""

    def __init__(self, text: str):
        found = _words(text.encode())
        self.words = [found.word(i) for i in range(len(found.starts))]
        self.least = max(1, math.ceil(LEAST_MATCHED * len(self.words)))
        self.longest = 2 * len(self.words) + 4  # words that are strewn more widely don't count
        self.stride = max(1, len(self.words) // 4)
        self.window = self.longest + self.stride  # every place lies in one
        telling = sorted(self.words, key=lambda w: (w in COMMON, -len(w), w))
        #: A place that lacks all of them lacks more words than it may.
        self.cues = frozenset(telling[:len(self.words) - self.least + 1])
        self.bits: dict[bytes, int] = {}
        for i, word in enumerate(self.words):
            self.bits[word] = self.bits.get(word, 0) | 1 << i

    def best_from(self, words: list[bytes | None], first: int) -> tuple[int, int, int] | None:
        """(score, end, matched) of the best place that begins with this word: most words
        matched in order, less the words missing and the words added."""
        size = len(self.words)
        full = (1 << size) - 1
        left, best, before = full, None, 0  # zero bits of left: the longest common subsequence
        for at in range(first, min(first + self.longest, len(words))):
            here = left & self.bits.get(words[at], 0)
            left = (left + here | left - here) & full
            matched = size - left.bit_count()
            if matched > before and matched >= self.least:
                found = 3 * matched - size - (at + 1 - first) + matched, at + 1, matched
                best = max(best or found, found, key=lambda f: (f[0], f[1]))
            before = matched
        return best

    def places(self, words: list[bytes | None]) -> Iterator[tuple[int, int, int, int]]:
        """(score, first, end, matched) of each place of enough words."""
        known = np.fromiter((w in self.bits for w in words), bool, len(words))
        before = np.concatenate(([0], np.cumsum(known)))
        upto = np.minimum(np.arange(len(words)) + self.longest, len(words))
        for first in np.flatnonzero(known & (before[upto] - before[:-1] >= self.least)).tolist():
            if found := self.best_from(words, first):
                yield found[0], first, *found[1:]

    def aligned(self, words: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
        """Words of the template that these, aligned with it, have and those that they don't have."""
        rows = [[0] * (len(words) + 1)]
        for own in self.words:
            row = [0]
            for j, word in enumerate(words):
                row.append(rows[-1][j] + 1 if own == word else max(rows[-1][j + 1], row[j]))
            rows.append(row)
        i, j, there, missing = len(self.words), len(words), [], []
        while i:
            if j and self.words[i - 1] == words[j - 1]:
                i, j = i - 1, j - 1
                there.append(self.words[i])
            elif j and rows[i][j - 1] >= rows[i - 1][j]:
                j -= 1
            else:
                i -= 1
                missing.append(self.words[i])
        return there[::-1], missing[::-1]


class Scanner:
    """Compares blocks with templates; equal blocks are compared once. Templates without a word are never found."""

    def __init__(self, templates: dict[str, str]):
        self.plain = _compressor(None)
        self.wording = {name: w for name, text in templates.items() if (w := Wording(text)).words}
        self.given = {name: _compressor(b" ".join(w.words)) for name, w in self.wording.items()}
        self.least = {name: LEAST_SAVED * len(self.plain.compress(b" ".join(w.words) + FILLER))
                      for name, w in self.wording.items()}
        #: Words before and after a cue: no window that holds it reaches further.
        self.reach = max((w.window for w in self.wording.values()), default=1)
        cues = sorted({cue for w in self.wording.values() for cue in w.cues}, key=lambda c: (-len(c), c))
        letter = rb"[0-9a-z\x80-\xff]"
        self.cue = re.compile(rb"(?<!" + letter + rb")(?:" + b"|".join(map(re.escape, cues)) + rb")(?!" + letter + rb")"
                              ) if cues else None
        self.known: dict[bytes, list[tuple]] = {}

    def find(self, text: bytes) -> list[tuple]:
        """Confirmed templates of a lower-case text: (start, end, name, rank, reduction, matched share,
        words missing, number of words added)."""
        cues = [cue.start() for cue in self.cue.finditer(text)] if self.cue else []
        if not cues:
            return []
        words, out = _words(text), []
        for low, high in blocks(np.searchsorted(words.starts, cues, "right") - 1, len(words.starts), self.reach):
            for first, last, *rest in self.scan([words.word(i) for i in range(low, high)]):
                out.append((int(words.starts[low + first]), int(words.ends[low + last]), *rest))
        return out

    def scan(self, block: list[bytes]) -> list[tuple]:
        """The same for the words of a block, with numbers of the first and last word as places."""
        if len(block) > 4 * self.reach:
            return self._scan(block)
        found = self.known.get(key := b" ".join(block))
        if found is None:
            if len(self.known) > CACHED_BLOCKS:
                self.known.clear()
            found = self.known[key] = self._scan(block)
        return found

    def reductions(self, found: bytes) -> dict[str, tuple[int, float]]:
        """Rank and reduction of each template for the words found, joined by blanks."""
        size = len(self.plain.compress(found + FILLER))
        ranked = sorted(((1 - len(c.compress(found + FILLER)) / size, name)
                         for name, c in self.given.items()), key=lambda x: (-x[0], x[1]))
        return {name: (rank, reduction) for rank, (reduction, name) in enumerate(ranked, 1)}

    def ranked(self, words: list[bytes | None], known: dict[tuple[str | None, bytes], int]) -> list[tuple]:
        """(bytes saved, share saved, template, first word, end) of the windows worth a look, most bytes first.
        ``known`` keeps compressed sizes from one ranking of a block to the next."""
        pieces = [b"\0" if w is None else w for w in words]
        text = b" ".join(pieces)
        starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces]))).tolist()
        found = []

        def size(by: str | None, compressor: zstandard.ZstdCompressor, window: bytes) -> int:
            if (by, window) not in known:
                known[by, window] = len(compressor.compress(window))
            return known[by, window]

        for name, wording in self.wording.items():
            step = wording.stride
            firsts = {first for i, w in enumerate(words) if w in wording.cues
                      for first in range(max(0, -(-(i - wording.window + 1) // step)) * step, i + 1, step)}
            for first in sorted(firsts):
                end = min(first + wording.window, len(words))
                window = text[starts[first]:starts[end] - 1] + FILLER
                plain = size(None, self.plain, window)
                saved = plain - size(name, self.given[name], window)
                if saved >= self.least[name]:
                    found.append((saved, saved / plain, name, first, end))
        return sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3]))

    def confirmed(self, name: str, words: list[bytes | None], places: list[tuple[int, int, int, int]], low: int,
                  high: int, blank: np.ndarray) -> tuple[int, int, int, int] | None:
        """The best place of a template that meets a place in the window: the most words less the differences, then the
        longest. Its words have to get smallest by this template; else they are another one's."""
        def best(some: list) -> tuple[int, int, int, int]:
            return max(some, key=lambda p: (p[0], p[2] - p[1], -p[1]))

        inside = [p for p in places if low <= p[1] and p[2] <= high]
        while inside:
            _, first, end, _ = best(inside)
            meeting = [p for p in places if p[1] < end and first < p[2] and not blank[p[1]:p[2]].any()]
            if meeting:
                place = best(meeting)
                found = b" ".join(w for w in words[place[1]:place[2]] if w is not None)
                if self.reductions(found)[name][0] == 1:
                    return place
            inside = [p for p in inside if p[2] <= first or end <= p[1]]
        return None

    def _scan(self, block: list[bytes]) -> list[tuple]:
        words: list[bytes | None] = list(block)
        winners: list[tuple] = []
        known: dict[tuple[str | None, bytes], int] = {}
        while True:
            places: dict[str, list[tuple[int, int, int, int]]] = {}
            blank = np.zeros(len(words), bool)
            for _, _, name, low, high in self.ranked(words, known):
                if blank[low:high].any():
                    break  # what is left of it may still save more than those that follow: all are ranked again
                wording = self.wording[name]
                if name not in places:
                    places[name] = list(wording.places(words))
                place = self.confirmed(name, words, places[name], low, high, blank)
                if place is None:
                    continue
                _, first, end, matched = place
                there, missing = wording.aligned(words[first:end])
                rank, reduction = self.reductions(b" ".join(there))[name]
                blank[first:end] = True
                winners.append((first, end - 1, name, rank, float(reduction),
                                matched / (len(there) + len(missing)), b" ".join(missing).decode(),
                                end - first - matched))
            if not blank.any():
                return sorted(winners)
            words = [None if b else w for w, b in zip(words, blank.tolist(), strict=True)]


def blocks(cues: np.ndarray, words: int, reach: int) -> list[tuple[int, int]]:
    """First word and end of each block of a text: ``reach`` words on either side of a cue's word. Blocks that
    meet are one."""
    found: list[tuple[int, int]] = []
    for cue in cues.tolist():
        low, high = max(0, cue - reach), min(words, cue + reach + 1)
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], high)
        else:
            found.append((low, high))
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, start, end, license, rank, reduction, matched, missing, added): one row for each
    template that is confirmed at a place of a document.

    ``start`` and ``end`` are byte offsets of the matching words, ``rank`` the template's place by
    ``reduction``, the share by which it makes the words found smaller, ``matched`` the share of its words that stand there in order, ``missing`` those that don't, ``added`` the number of words
    between. All templates and all copies are given; of those that overlap, the one whose window saves the most bytes.
    Null and empty texts have no blocks; repeated rows each give their rows; a null ``doc_id`` is kept. Very long texts are
    read whole, block by block; other columns are not looked at, whatever their names. No rows give no rows.
    """
    wordings = TEMPLATES if templates is None else templates
    out_names = ["doc_id", "start", "end", "license", "rank", "reduction", "matched", "missing", "added"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings)
        for batch in slices(batches, "_text"):
            data, bounds = flat(batch.column("_text"))
            whole, rows = data.tobytes().lower(), []  # bytes: only A-Z change
            ids = batch.column("doc_id").to_pylist()
            for row, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                rows += [(ids[row], *found) for found in scanner.find(whole[low:high])]
            if rows:
                schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("license", pa.string()), ("rank", pa.int32()),
                                    ("reduction", pa.float64()), ("matched", pa.float64()),
                                    ("missing", pa.string()), ("added", pa.int32())])
                yield pa.RecordBatch.from_pylist([dict(zip(out_names, r, strict=True)) for r in rows], schema)

    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("_text"))
            .mapInArrow(find, "doc_id long, " + _FOUND))
