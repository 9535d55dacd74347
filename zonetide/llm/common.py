"""Tables in the shared folder, bounded batches of text, hashes of byte spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # text that a task works on at once; longer documents come alone
ROW_KEY = ("_id", "_text_hash")

# Multipliers of the span hashes: odd, otherwise without meaning.
STEP = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``). Only where the session
    names none, as in tests, one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="zonetide-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads it back, which cuts
    the lineage: a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def unused_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def keyed(docs: DataFrame) -> DataFrame:
    """``_id``, ``_text_hash`` and ``_text`` of each document: what identifies a row, also where
    ids are null or repeat. Rows equal in both are one document."""
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("_id"),
                       F.xxhash64(text).alias("_text_hash"), text.alias("_text"))


def on_key(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_text_hash"] == right["_text_hash"])


def slices(batches: Iterable[pa.RecordBatch], column: str | int,
           limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = flat(batch.column(column % batch.num_columns if isinstance(column, int) else column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and the last one ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def starts_within(bounds: np.ndarray, size: int) -> np.ndarray:
    """Flags the first byte of each non-empty row."""
    flags = np.zeros(size + 1, bool)
    flags[bounds[:-1]] = True
    return flags[:size]


def spans_of(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of flagged bytes; a run ends where ``first`` starts a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate(([False], inside[:-1])) & ~first
    after = np.concatenate((inside[1:] & ~first[1:], [False]))
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_BYTE_VALUES = np.arange(1, 257, dtype=np.uint64)
_POWERS = np.ones(64, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, 64):
        _POWERS[_i] = _POWERS[_i - 1] * np.uint64(STEP)


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(29))
    values *= np.uint64(MIX)
    values ^= values >> np.uint64(32)
    return values


def run_hashes(values: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``values``; runs begin at ``starts`` and follow each other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, np.diff(starts, append=len(values)))
    salted = mixed(values + np.uint64(seed))
    return mixed(np.add.reduceat(mixed(salted + place.astype(np.uint64) * np.uint64(STEP)), starts))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Spans don't overlap and come in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    where = place + np.repeat(starts, lengths)
    values = _BYTE_VALUES[data[where]] * _POWERS[place & 63]
    # Every 64 bytes a new factor, so that the place in a long span counts too.
    if lengths.max() > 64:
        values = mixed(values + (place >> 6).astype(np.uint64) * np.uint64(MIX))
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        short = lengths <= 64
        if short.any():
            keep = np.repeat(short, lengths)
            plain = _BYTE_VALUES[data[where[keep]]] * _POWERS[place[keep] & 63]
            sizes = lengths[short]
            sums[short] = np.add.reduceat(plain, np.cumsum(sizes) - sizes)
        return mixed(sums)
    return mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths))


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a batch of texts: runs of letters and digits, A-Z in lower case. Every
    byte above 127 counts as a letter."""

    def __init__(self, texts: pa.Array):
        raw, self.bounds = flat(texts)
        self.data = _LOWER[raw]
        first = starts_within(self.bounds, len(raw))
        self.starts, self.ends = spans_of(_WORD_BYTE[raw], first)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        #: Number of the first word of each row, and at the end the number of words.
        self.rows = np.searchsorted(self.starts, self.bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def per_word(self, cache: dict, values) -> np.ndarray:
        """What ``values(list of words)`` gives for each word, computed once for equal words.
        ``cache`` keeps results from batch to batch; it is emptied when it grows large."""
        distinct, first, back = np.unique(self.hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(cache) > 400_000:
            cache.clear()
        new = [i for i, key in enumerate(keys) if key not in cache]
        if new:
            cache.update(zip([keys[i] for i in new],
                             values([self.word(first[i]) for i in new]), strict=True))
        return np.array([cache[key] for key in keys])[back] if keys else np.zeros(0)


def per_row(function, values: np.ndarray, rows: np.ndarray, empty) -> np.ndarray:
    """``function.reduceat`` over the values of each row; rows without values get ``empty``."""
    out = np.full(len(rows) - 1, empty, dtype=np.asarray(values).dtype if len(values) else float)
    filled = np.flatnonzero(rows[1:] > rows[:-1])
    if len(filled):
        out[filled] = function.reduceat(values, rows[filled])
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trained_on: Column,
                    at_most: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``at_most`` documents of each class: those whose ids have the
    smallest hashes among the labelled rows where ``trained_on`` (of ``doc_id``) holds. Texts over
    ``max_bytes`` aren't learned from. The bounds keep the sample small enough for the driver."""
    labels = (labels.select(labels["doc_id"].cast("long").alias("doc_id"),
                            labels[label].cast("int").alias("_label"))
              .where(trained_on & F.col("doc_id").isNotNull()))
    chosen = None
    for value in (0, 1):
        ids = (labels.where(F.col("_label") == value).select("doc_id", "_label").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most))
        chosen = ids if chosen is None else chosen.union(ids)
    text = text_of(docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("_text"))
    rows = (texts.where(F.octet_length("_text") <= max_bytes)
            .join(F.broadcast(chosen), "doc_id")  # 2 * at_most ids
            .select("doc_id", "_text", "_label").collect())
    return [(r["_text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["_text"]))]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold,
                      F.lit(False))
