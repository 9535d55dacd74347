"""Near-duplicates by SimHash fingerprints, found with Golay-code keys.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each padded with zeros
to 23, the length of the perfect Golay code. Where two fingerprints differ in at most three
bits, two of the segments differ in at most one bit each. A segment is stored under its nearest
codeword. It is looked up under its nearest codeword and, if three bits away from that, under the five
codewords four bits away: the nearest codeword of a segment that differs in one bit is
always among these. So each fingerprint is stored under 3 keys (pairs of codewords, 24 bits) and
looked up under at most 108; rows that meet are verified bit by bit.

Rows of a key meet in sorted order within a task. Only links that join two groups not yet joined
there are passed on, so a large group of copies gives as many links as it has members, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import partitions, slices, stored, text_of
from zonetide.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and number of bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the (23, 12) Golay code
STORED_AT_ONCE = 4096  # stored rows of a key that one task compares with all its lookups
BLOCK = 1 << 20        # comparisons held in memory at once


def fingerprint(text: str) -> int:
    """The fingerprint of one text: bit j is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(whole, SEED)
    lengths = np.array([len(w) for w in words]) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(
        starts[:-SHINGLE].tolist(), (starts[SHINGLE:] - 1).tolist(), strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_fp``, the fingerprint as a signed long, to the documents. Null text is empty."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_whole"):
            values = [fingerprint(t) for t in batch.column("_whole").to_pylist()]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(signed)],
                names=[*batch.schema.names[:-1], "_fp"])

    kept = docs.drop("_fp", "_whole")
    return (kept.withColumn("_whole", text_of(kept, text))
            .mapInArrow(add, kept.withColumn("_fp", F.lit(0).cast("long")).schema))


# --- the code ---------------------------------------------------------------------------------

def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the nearest error pattern, and those of four bits if that has three (-1: none)."""
    nearest, further = np.full(2048, -1, np.int64), np.full((2048, 5), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
        of = _syndromes(errors)
        if weight < 4:
            nearest[of] = errors
            continue
        for syndrome, error in zip(of.tolist(), errors.tolist(), strict=True):
            if nearest[syndrome].item().bit_count() == 3:
                further[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return nearest, further


_TABLES: list[np.ndarray] = []


def codewords(segment: np.ndarray) -> np.ndarray:
    """Numbers (12 bits) of the codewords near each 23-bit segment: the nearest first, then those
    four bits away if the nearest is three bits away, else -1."""
    if not _TABLES:
        _TABLES.extend((*_patterns(), _syndromes(np.arange(1 << 12)),
                        _syndromes(np.arange(1 << 11) << 12)))
    nearest, further, low, high = _TABLES
    syndrome = low[segment & 0xFFF] ^ high[segment >> 12]
    errors = np.concatenate([nearest[syndrome][:, None], further[syndrome]], axis=1)
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys to store fingerprints under and to look them up under: (row, key, row, key)."""
    near = [codewords((prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
            for at, bits in SEGMENTS]
    rows = np.arange(len(prints))
    kept, kept_keys, asked, asked_keys = [], [], [], []
    for pair, (one, other) in enumerate(combinations(range(3), 2)):
        tag = pair << 24
        kept.append(rows)
        kept_keys.append(tag | near[one][:, 0] << 12 | near[other][:, 0])
        for i in range(6):
            for j in range(6):
                a, b = near[one][:, i], near[other][:, j]
                there = np.flatnonzero((a >= 0) & (b >= 0))
                asked.append(there)
                asked_keys.append(tag | a[there] << 12 | b[there])
    return tuple(np.concatenate(x) for x in (kept, kept_keys, asked, asked_keys))


# --- links ------------------------------------------------------------------------------------

_KEYED = "key int, salt int, lookup boolean, fp long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 13):
            fp = batch.slice(at, 1 << 13).column("fp").to_numpy()
            kept, kept_keys, asked, asked_keys = keys(fp.view(np.uint64))
            for lookup, row, key in ((False, kept, kept_keys), (True, asked, asked_keys)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(np.zeros(len(key), np.int32)),
                     pa.array(np.full(len(key), lookup)), pa.array(fp[row])],
                    names=["key", "salt", "lookup", "fp"])


class _Groups:
    """Groups of fingerprints joined so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _matches(stored_key, stored_fp, asked_key, asked_fp):
    """Pairs of equal key and at most three differing bits, in blocks of bounded size."""
    low = np.searchsorted(stored_key, asked_key, "left")
    count = np.searchsorted(stored_key, asked_key, "right") - low
    rows = np.flatnonzero(count)
    while len(rows):
        upto = max(1, int(np.searchsorted(np.cumsum(count[rows]), BLOCK, "right")))
        now, rows = rows[:upto], rows[upto:]
        n = count[now]
        other = np.repeat(low[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b = np.repeat(asked_fp[now], n), stored_fp[other]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS) & (a != b)
        if near.any():
            yield np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], 1), axis=0)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and salt, stored ones before lookups."""
    held_key = held_fp = np.zeros(0, np.int64)
    groups = _Groups()
    for batch in batches:
        if not batch.num_rows:
            continue
        place = (batch.column("key").to_numpy().astype(np.int64) << 32
                 | batch.column("salt").to_numpy())
        lookup = batch.column("lookup").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy()
        held_key = np.concatenate([held_key, place[~lookup]])
        held_fp = np.concatenate([held_fp, fp[~lookup]])
        found = []
        for pairs in _matches(held_key, held_fp, place[lookup], fp[lookup]):
            found += [(a, b) for a, b in pairs.tolist() if groups.join(a, b)]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             names=["a", "b"])
        if len(groups.parent) > 1_000_000:
            groups = _Groups()  # at worst some links are passed on twice
        rest = held_key >= place[-1]
        held_key, held_fp = held_key[rest], held_fp[rest]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: enough of those with at most three
    differing bits to connect all that are connected."""
    spark = distinct.sparkSession
    rows = distinct.select("fp").mapInArrow(_keyed, _KEYED)
    # Keys under which very many are stored are split; their lookups go to every part.
    crowded = stored(distinct.select("fp").mapInArrow(_stored_keys, "key int")
                     .groupBy("key").count().where(F.col("count") > STORED_AT_ONCE)
                     .select("key", F.ceil(F.col("count") / STORED_AT_ONCE).cast("int")
                             .alias("parts")), "crowded")
    if not crowded.isEmpty():
        salted = rows.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        rows = salted.select("key", F.explode(F.when(F.col("lookup"), every)
                                              .otherwise(F.array(own))).alias("salt"),
                             "lookup", "fp")
    return (rows.repartition(partitions(spark), "key", "salt")
            .sortWithinPartitions("key", "salt", "lookup")
            .mapInArrow(_links, "a long, b long"))


def _stored_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            _, key, _, _ = keys(batch.column("fp").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32))], names=["key"])


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, _fp, component_id, _component); ``_component`` is a fingerprint."""
    text = text_of(docs)
    prints = stored(fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                                             F.xxhash64(text).alias("_text_hash"),
                                             text.alias("text"))).drop("text"), "prints")
    distinct = prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first"))
    linked = stored(components(links(distinct)), "linked")
    # The smallest id of each component of fingerprints.
    names = (distinct.join(linked, distinct["fp"] == linked["node"])
             .groupBy("component").agg(F.min("first").alias("name")))
    named = linked.join(names, "component").select(F.col("node").alias("fp"), "component", "name")
    # Stored, so that the join below can split a fingerprint that very many documents share.
    found = stored(distinct.join(named, "fp", "left").select(
        F.col("fp").alias("_fp"),
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("name"))
        .alias("component_id"), F.coalesce("component", "fp").alias("_component")), "found")
    return prints.join(found, "_fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest ``doc_id`` reachable over
    links of at most three differing bits, the document itself included. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null ``doc_id`` link others but
    name no component; if all its ids are null, so is its name. Repeated rows each come back.
    """
    return _grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = _grouped) -> DataFrame:
    """One document of each component, with its own columns: that with the smallest id, of rows
    with this id one of the text with the smallest hash. A row without an id stays only where no
    document of the component has one. ``grouped`` gives doc_id, _text_hash and _component of each row."""
    key = (F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"),
           F.col("_text_hash"))
    kept = (grouped(docs).groupBy("_component").agg(F.min(F.struct(*key)).alias("_first"))
            .select("_first.*"))
    columns = [docs[c] for c in docs.columns]
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.struct(*columns).alias("_row"), doc_id.isNull().alias("_no_id"),
                       F.coalesce(doc_id, F.lit(0)).alias("_id"),
                       F.xxhash64(text_of(docs)).alias("_text_hash"))
    names = ["_no_id", "_id", "_text_hash"]
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select("_row.*")
