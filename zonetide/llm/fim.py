"""Fill-in-the-middle: texts cut at two token ends and put together in another order.

A token is a run of ASCII white space with the other characters after it, or the white space that ends a
text. Every byte of a batch of texts gets a class: whether it goes on with a code point, whether it is white
space, whether a token ends with it. A wavelet matrix over the classes answers how many tokens end, and how many
code points begin, before any place; the cuts are found by bisection on those ranks, for all texts of the batch at
once. Texts stay UTF-8 bytes, and a cut never falls into a code point, since the next byte is white space
or the text ends.

Where the cuts lie, and the form, follow from a digest of ``doc_id`` alone, so a row comes out the same wherever and
whenever it is computed. Rows don't depend on each other; there is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from zonetide.llm.common import flat, slices, text_of, unused_name
from zonetide.llm.wavelet import WaveletMatrix

SEED = 42
RATE = 50      # of 100 texts are rearranged, about
SPM_RATE = 80  # of 100 of those start with the suffix, about

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

# Classes of bytes: bit 0, a token ends here; bit 1, white space; bit 2, goes on with a code point.
_ENDS, _BLANK, _GOES_ON = 1, 2, 4
TOKEN_ENDS = (_ENDS, _ENDS | _BLANK, _ENDS | _GOES_ON)
GOING_ON = (_GOES_ON, _GOES_ON | _ENDS)

_NOWHERE = np.zeros(0, np.int64)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[128:192] = _GOES_ON


class Tokens:
    """Token ends and code points of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.data, self.bounds = flat(texts)
        classes = _CLASS[self.data]
        blank = classes == _BLANK
        ends = np.empty(len(blank), bool)
        ends[:-1] = ~blank[:-1] & blank[1:]
        last = self.bounds[1:][np.diff(self.bounds) > 0] - 1
        ends[last] = True
        self.matrix = WaveletMatrix(classes | ends, 3)
        self.before = self.matrix.rank_of(TOKEN_ENDS, self.bounds)
        #: Tokens of each text.
        self.counts = np.diff(self.before)

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """The byte after the first ``tokens`` tokens of each text."""
        found = self.matrix.select_of(TOKEN_ENDS, self.before[:-1] + tokens, self.bounds[:-1], self.bounds[1:])
        return np.where(tokens == 0, self.bounds[:-1], found)

    def code_points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return end - start - (self.matrix.rank_of(GOING_ON, end) - self.matrix.rank_of(GOING_ON, start))

    def marked(self) -> np.ndarray:
        """Which texts hold one of the three marks."""
        data, out = self.data, np.zeros(len(self.counts), bool)
        at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) > 2 else _NOWHERE
        at = at[np.isin(data[at + 1], np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)[1::3])]
        row = np.searchsorted(self.bounds, at, side="right") - 1
        out[row[at + 3 <= self.bounds[row + 1]]] = True
        return out


def draws(doc_ids: pa.Array, seed: int) -> np.ndarray:
    """Four numbers for each id; a null id counts as empty text."""
    out = np.empty((len(doc_ids), 4), np.int64)
    for row, doc_id in enumerate(doc_ids.to_pylist()):
        text = f"{seed}:{'' if doc_id is None else doc_id}"
        out[row] = np.frombuffer(hashlib.sha256(text.encode()).digest()[:16], ">u4")
    return out


def _arranged(seed: int, rate: int, spm_rate: int):
    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in slices(batches, -1):
            names = [*batch.schema.names[:-2], "n", "form", "prefix_chars", "middle_chars", "output"]
            tokens = Tokens(batch.column(batch.num_columns - 1))
            drawn = draws(batch.column(batch.num_columns - 2), seed)
            one, two = drawn[:, 0] % (tokens.counts + 1), drawn[:, 1] % (tokens.counts + 1)
            start, end = tokens.bounds[:-1], tokens.bounds[1:]
            first, second = tokens.place(np.minimum(one, two)), tokens.place(np.maximum(one, two))
            plain = (start == end) | (drawn[:, 2] % 100 >= rate) | tokens.marked()
            spm = drawn[:, 3] % 100 < spm_rate
            raw, outputs = tokens.data.tobytes(), []
            for row, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in (start, first, second, end)), strict=True)):
                if plain[row]:
                    outputs.append(raw[a:d])
                elif spm[row]:
                    outputs.append(b"".join((SUFFIX, raw[c:d], PREFIX, raw[a:b], MIDDLE, raw[b:c])))
                else:
                    outputs.append(b"".join((PREFIX, raw[a:b], SUFFIX, raw[c:d], MIDDLE, raw[b:c])))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-2], pa.array(tokens.counts),
                pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
                pa.array(tokens.code_points(start, first), mask=plain),
                pa.array(tokens.code_points(first, second), mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string())], names=names)
    return arranged


def rearrange(docs: DataFrame, text: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> DataFrame:
    """The documents with ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code
    points, null if plain) and ``output``; columns of those names are replaced, all others are kept.

    Plain texts stay as they are: empty and null ones (null counts as empty, ``n`` is 0), texts that hold a mark, and
    those not drawn. A null ``doc_id`` is drawn for as an empty id. Equal rows come out equal. A text of any length is
    taken whole; it alone, and twice that for its output, is in memory then. No rows give no rows.
    """
    kept = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    number = docs["doc_id"].cast("long").alias(unused_name(kept, "number"))
    rows = docs.select(*[docs[c] for c in kept.columns], number, text_of(docs, text).alias(unused_name(kept, "whole")))
    added = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(),
             "output": StringType()}
    schema = StructType([*kept.schema, *[StructField(name, kind) for name, kind in added.items()]])
    return rows.mapInArrow(_arranged(seed, rate, spm_rate), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Texts with marks of their own are plain, so the marks are unambiguous."""
    parts = F.split(output, "<[PSM]>")
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(one, middle, two))
            .when(form == "spm", F.concat(two, middle, one)).otherwise(output))
