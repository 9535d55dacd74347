"""Substring dedup by hashed units.

A text is cut into units: the sentences of its lines, told apart by ``. ! ?`` and line ends. A unit
is normalised to its words (runs of letters and digits, A-Z in lower case) and hashed to 96 bits.
The earliest unit of each hash, by document id and place, stays. Later ones are
removed where they make up a whole line, or with their neighbours at least eight words: so repeated
lines go, as do longer passages repeated inside lines, while a clean document keeps a short
sentence that another happens to have too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import Words, flat, keyed, on_key, run_hashes, slices, stored, text_of

MIN_WORDS = 8

_ENDS_UNIT = np.zeros(256, np.int64)
_ENDS_UNIT[[10, 33, 46, 63]] = 1
_UNIT_COLUMNS = "_id long, _text_hash long, place int, h1 long, h2 int"


class Units:
    """Units of a batch of texts. A unit reaches from its first word to the next unit's."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        at, data = words.starts, words.data
        row = np.repeat(np.arange(len(texts)), np.diff(words.rows))
        ended = np.cumsum(_ENDS_UNIT[data])[at] if len(at) else at
        lines = np.cumsum(data == 10)[at] if len(at) else at
        changed = np.diff(row, prepend=-1) != 0
        first = np.flatnonzero(changed | (np.diff(ended, prepend=-1) != 0))
        self.words = np.diff(first, append=len(at))
        self.h1 = run_hashes(words.hashes, first, 1).view(np.int64)
        self.h2 = run_hashes(words.hashes, first, 2).astype(np.uint32).view(np.int32)
        self.row = row[first]
        #: Number of the first unit of each row, and at the end the number of units.
        self.rows = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.start = at[first]
        end = np.append(self.start[1:], len(data))
        self.end = np.minimum(end, words.bounds[self.row + 1]) if len(first) else end[:0]
        #: Units that begin a line.
        self.new_line = (np.diff(lines[first], prepend=-1) != 0) | (np.diff(self.row, prepend=-1) != 0)
        self.data, self.bounds = data, words.bounds

    def removed(self, repeated: np.ndarray, min_words: int) -> np.ndarray:
        """Which of the repeated units go."""
        if not len(repeated):
            return repeated
        line = np.flatnonzero(self.new_line)
        whole = np.repeat(np.logical_and.reduceat(repeated, line),
                          np.diff(line, append=len(repeated)))
        run = np.flatnonzero((np.diff(repeated.astype(np.int8), prepend=-1) != 0)
                             | (np.diff(self.row, prepend=-1) != 0))
        goes = (np.logical_or.reduceat(whole, run)
                | (np.add.reduceat(self.words, run) >= min_words))
        return repeated & np.repeat(goes, np.diff(run, append=len(repeated)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        units = Units(batch.column("_text"))
        place = np.arange(len(units.row)) - units.rows[units.row]
        key = [batch.column(c).take(pa.array(units.row)) for c in ("_id", "_text_hash")]
        yield pa.RecordBatch.from_arrays(
            [*key, pa.array(place.astype(np.int32)), pa.array(units.h1), pa.array(units.h2)],
            names=["_id", "_text_hash", "place", "h1", "h2"])


def repeated_units(docs: DataFrame) -> DataFrame:
    """(_id, _text_hash, places): which units of a document repeat an earlier one.

    The shuffles hold one narrow row for each unit; a hash that a third of them share is
    counted before the shuffle and its rows are joined with a single one."""
    units = keyed(docs).mapInArrow(_hashed, _UNIT_COLUMNS)
    # Stored, so that the join can split a hash that very many units share.
    often = stored(units.groupBy("h1", "h2").count().where(F.col("count") > 1)
                   .select("h1", "h2"), "often")
    shared = stored(units.join(often, ["h1", "h2"]), "units")
    rank = F.struct(F.col("_id").isNull().alias("last"), "_id", "_text_hash", "place")
    first = stored(shared.groupBy("h1", "h2").agg(F.min(rank).alias("first")), "first")
    later = shared.join(first, ["h1", "h2"]).where(rank != F.col("first"))
    return (later.groupBy("_id", "_text_hash")
            .agg(F.array_sort(F.collect_set("place")).alias("places")))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with ``text`` as it is after the removal, and ``n_units``, ``n_removed`` (units),
    ``removed_bytes`` and ``removed_spans``: byte offsets in the original text. Columns of
    these names are replaced.

    Ranks are by ``doc_id``, null ids last; rows equal in id and text count as one document, and
    each comes back. Null text is empty and stays empty. A document of which nothing is left stays.
    """
    added = ("n_units", "n_removed", "removed_bytes", "removed_spans")
    kept = docs.drop(*added)
    columns = [kept[c] for c in kept.columns if c != "text"]
    names = [c for c in kept.columns if c != "text"]
    key = repeated_units(docs)
    text = text_of(kept)
    wide = kept.select(F.struct(*columns).alias("_row"), text.alias("_text"),
                       kept["doc_id"].cast("long").alias("_id"),
                       F.xxhash64(text).alias("_text_hash"))
    joined = (wide.join(key, on_key(wide, key), "left")
              .select("_row", "_text", F.coalesce("places", F.array().cast("array<int>"))
                      .alias("places")))
    out = wide.select("_row", "_text").withColumns({
        "n_units": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"),
        "removed_bytes": F.lit(0).cast("long"),
        "removed_spans": F.array().cast("array<struct<start:long,end:long>>")})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            units = Units(batch.column("_text"))
            places = batch.column("places")
            lengths = np.diff(places.offsets.to_numpy())
            marked = (places.flatten().to_numpy()
                      + np.repeat(units.rows[:-1], lengths)).astype(np.int64)
            repeated = np.zeros(len(units.row), bool)
            repeated[marked] = True
            yield _without(batch, units, units.removed(repeated, min_words))

    done = joined.mapInArrow(cut, out.schema)
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c)
                         for c in (kept.columns if "text" in kept.columns else [*names, "text"])],
                       *added)


def _without(batch: pa.RecordBatch, units: Units, goes: np.ndarray) -> pa.RecordBatch:
    data, _ = flat(batch.column("_text"))
    inside = np.diff(goes.astype(np.int8), prepend=0)
    same_row = np.diff(units.row, prepend=-1) == 0
    opens = goes & ((inside == 1) | ~same_row)
    closes = np.append(opens[1:] | ~goes[1:], True)[:len(goes)] & goes
    start, end, row = units.start[opens], units.end[closes], units.row[opens]
    level = np.zeros(len(data) + 1, np.int64)
    np.add.at(level, start, 1)
    np.add.at(level, end, -1)
    keep = np.cumsum(level[:-1]) == 0
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    bounds = kept_before[units.bounds]
    texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [
        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    offset = units.bounds[row]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start - offset), pa.array(end - offset)],
                                   names=["start", "end"]))
    removed = np.concatenate(([0], np.cumsum(goes)))[units.rows]
    return pa.RecordBatch.from_arrays(
        [batch.column("_row"), texts.cast(pa.string()), pa.array(np.diff(units.rows)),
         pa.array(np.diff(removed)), pa.array(np.diff(units.bounds) - np.diff(bounds)), spans],
        names=["_row", "_text", "n_units", "n_removed", "removed_bytes", "removed_spans"])
