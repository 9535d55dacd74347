"""Near copies by shingles of five words: Jaccard similarity of at least 0.8, checked exactly.

Words are told apart by ASCII white space, A-Z in lower case; a text of fewer than five words is one shingle.
Texts with equal shingles are one node. Candidates come from two sources: SimHash fingerprints of the shingles that meet
under Golay-code keys and differ in at most three bits (see ``simhash``), which joins most copies cheaply, and 30 keys of five
MinHash values each for those that differ in more: a pair of similarity 0.8 shares none of them with probability
(1 - 0.8^5)^30, less than 1 in 100 000.

The members of a key are first compared with one of them. Keys whose members aren't all joined by that stay open: their
members, each with its shingles, meet in a task, which compares those of different groups and passes on only links
that join two groups. So rows stay in proportion to members, however many of them are alike or nearly alike; no pair is
left out. A key with very many shingles is split: each part holds some of its members, and those outside the key's largest
group are sent to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm import simhash
from zonetide.llm.common import (_LOWER, flat, keyed, mixed, on_key, partitions, run_hashes, slices, span_hashes,
                                 spans_of, starts_within, stored)
from zonetide.llm.components import components

SHINGLE = 5
LEAST = 0.8
KEYS = 30
VALUES = 5  # of each key
PART = 1 << 19  # shingles of a key, about, that one task holds at once
ASKED_AT_ONCE = 512

_NO_BLANK = np.ones(256, bool)
_NO_BLANK[[9, 10, 11, 12, 13, 32]] = False
_random = np.random.default_rng(5)
_FLIP = _random.integers(0, 1 << 32, KEYS * VALUES, dtype=np.uint32)
_FACTOR = _random.integers(0, 1 << 32, KEYS * VALUES, dtype=np.uint32) | np.uint32(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and where each text's begin and the last one's end."""
    raw, bounds = flat(texts)
    starts, ends = spans_of(_NO_BLANK[raw], starts_within(bounds, len(raw)))
    words = span_hashes(_LOWER[raw], starts, ends)
    rows = np.searchsorted(starts, bounds)
    count = np.diff(rows)
    many = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(count)), many)
    first = rows[row] + np.arange(out[-1]) - out[row]
    hashes = np.zeros(len(first), np.uint64)
    whole = count[row] >= SHINGLE
    for place in range(SHINGLE):
        hashes[whole] += mixed(words[first[whole] + place] + np.uint64(2 * place + 1))
    hashes = mixed(hashes)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        inside = np.repeat((count > 0) & (count < SHINGLE), count)
        hashes[out[short]] = run_hashes(words[inside], np.cumsum(count[short]) - count[short], SHINGLE)
    return hashes, out


def _fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bit j is set if it is set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0]


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        hashes, bounds = shingles(batch.column("_text"))
        filled = np.flatnonzero(np.diff(bounds))
        nodes, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
        prints = np.zeros(batch.num_rows, np.uint64)
        for row in filled.tolist():
            own = np.unique(hashes[bounds[row]:bounds[row + 1]])
            nodes[row], sizes[row] = xxhash.xxh64_intdigest(own.tobytes()), len(own)
            prints[row] = _fingerprint(own)
        keys = np.zeros((len(filled), KEYS), np.uint64)
        if len(filled):
            values = (hashes >> np.uint64(32)).astype(np.uint32)
            for key in range(KEYS):
                for j in range(key * VALUES, (key + 1) * VALUES):
                    least = np.minimum.reduceat((values ^ _FLIP[j]) * _FACTOR[j], bounds[filled])
                    keys[:, key] = mixed(keys[:, key] + least + np.uint64(key + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_text_hash"), pa.array(nodes.view(np.int64)), pa.array(sizes),
             pa.array(prints.view(np.int64)),
             pa.ListArray.from_arrays(pa.array((np.searchsorted(filled, np.arange(batch.num_rows + 1)) * KEYS)
                                               .astype(np.int32)), pa.array(keys.ravel().view(np.int64)))],
            names=["_id", "_text_hash", "node", "size", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each node, sorted."""
    for batch in slices(batches, "_text"):
        hashes, bounds = shingles(batch.column("_text"))
        own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(own)], names=["node", "shingles"])


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1])


def _near(same: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    return same >= LEAST * (size + sizes - same)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            pairs = zip(_arrays(batch.column("set_a")), _arrays(batch.column("set_b")), strict=True)
            near = [_near(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) for a, b in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def joining(held: list[np.ndarray], asked: list[np.ndarray], held_group: np.ndarray, asked_group: np.ndarray
            ) -> list[tuple[int, int]]:
    """(asked, held) numbers of similar sets of different groups, as many as it takes to join all groups that such
    pairs join. Only shingles that several sets hold are compared, as bits of words."""
    sets = [*held, *asked]
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    kept = count[place] > 1
    row = np.repeat(np.arange(len(sets)), sizes)[kept]
    width = -(-max(int(common[-1]) + 1, 1) // 64)
    bit = row * width * 64 + common[place[kept]]  # rising, since the sets are sorted
    bits = np.zeros(len(sets) * width * 8, np.uint8)
    if len(bit):
        first = np.flatnonzero(np.diff(bit >> 3, prepend=-1))
        bits[bit[first] >> 3] = np.bitwise_or.reduceat(np.uint8(1) << (bit & 7).astype(np.uint8), first)
    words = bits.view(np.uint64).reshape(len(sets), width)
    group = np.concatenate((held_group, asked_group))
    found = []
    for number in range(len(asked)):
        own = len(held) + number
        other = np.flatnonzero((group[:len(held)] != group[own]) & (sizes[:len(held)] >= LEAST * sizes[own])
                               & (LEAST * sizes[:len(held)] <= sizes[own]))
        same = np.bitwise_count(words[other] & words[own]).sum(axis=1, dtype=np.int64)
        for there in other[_near(same, sizes[own], sizes[other])].tolist():
            if group[there] != group[own]:
                found.append((number, there))
                group[group == group[there]] = group[own]
    return found


class _Key:
    """The members of one part of a key."""

    def __init__(self):
        self.nodes, self.groups, self.sets = [], [], []

    def add(self, nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> None:
        self.nodes.append(nodes)
        self.groups.append(groups)
        self.sets += sets

    def links(self, nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        held, held_groups = np.concatenate(self.nodes), np.concatenate(self.groups)
        pairs = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(nodes), ASKED_AT_ONCE):
            now = slice(at, at + ASKED_AT_ONCE)
            names = np.unique(np.concatenate((held_groups, groups[now])), return_inverse=True)[1]
            found = joining(self.sets, sets[now], names[:len(held)], names[len(held):])
            pairs += [np.array([(nodes[at + a], held[b]) for a, b in found], np.int64).reshape(-1, 2)]
        return np.concatenate(pairs)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and part, with the part's own members first, then those sent to it."""
    place, key, waiting = None, _Key(), _Key()

    def among(key: _Key, waiting: _Key) -> Iterator[pa.RecordBatch]:
        """Links of the part's own members that ask."""
        if waiting.nodes:
            pairs = key.links(np.concatenate(waiting.nodes), np.concatenate(waiting.groups), waiting.sets)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.stack([batch.column("key").to_numpy(), batch.column("part").to_numpy().astype(np.int64),
                            batch.column("sent").to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
        nodes, groups = batch.column("node").to_numpy(), batch.column("component").to_numpy()
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        sets = _arrays(batch.column("shingles"))
        change = np.flatnonzero((np.diff(numbers, axis=0) != 0).any(axis=1)) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), len(nodes)], strict=True):
            here, sent = tuple(numbers[low, :2].tolist()), bool(numbers[low, 2])
            if here != place:
                yield from among(key, waiting)
                place, key, waiting = here, _Key(), _Key()
            if sent:
                if key.nodes:
                    pairs = key.links(nodes[low:high], groups[low:high], sets[low:high])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                continue
            key.add(nodes[low:high], groups[low:high], sets[low:high])
            asking = low + np.flatnonzero(asks[low:high])
            if len(asking):
                waiting.add(nodes[asking], groups[asking], [sets[i] for i in asking])
    yield from among(key, waiting)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar."""
    found = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
             .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a"))
    return stored(found.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long"), "similar")


def _open_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between groups that share a key; ``placed`` has the group (component) of each member of each key."""
    groups = placed.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("size").alias("shingles"))
    open_keys = stored(groups.groupBy("key").agg(
        F.count("*").alias("groups"), F.max_by("component", F.struct("members", "component")).alias("main"),
        F.ceil(F.sum("shingles") / PART).cast("int").alias("parts"))
        .where("groups > 1").select("key", "main", "parts"), "open")
    members = placed.join(open_keys, "key").withColumns({
        "asks": F.col("component") != F.col("main"), "own": F.pmod(F.xxhash64("node"), "parts").cast("int")})
    every = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: part != F.col("own"))
    dealt = members.select("key", "node", "component", "asks", F.col("own").alias("part"), F.lit(False).alias("sent")
                           ).union(members.where("asks AND parts > 1").select(
                               "key", "node", "component", "asks", F.explode(every).alias("part"), F.lit(True)))
    rows = dealt.join(sets, "node").select("key", "part", "sent", "node", "component", "asks", "shingles")
    return stored(rows.repartition(partitions(placed.sparkSession), "key", "part")
                  .sortWithinPartitions("key", "part", "sent").mapInArrow(_met, "a long, b long"), "met")


def _printed_alike(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes to compare, by their fingerprints: one node stands for all of its fingerprint, and those
    of fingerprints that differ in at most three bits are paired."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
    linked = simhash.links(first)
    name = [first.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")) for c in "ab"]
    same = nodes.join(first, "fp").where(F.col("node") != F.col("first"))
    return (linked.join(name[0], "a").join(name[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
            .union(same.select(F.col("first").alias("a"), F.col("node").alias("b"))))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, _component) of each document. Null and empty texts have no shingles and are one
    component; rows with a null ``doc_id`` link others. Texts of any length are taken whole; other columns don't matter."""
    prints = stored(keyed(docs).mapInArrow(
        _printed, "_id long, _text_hash long, node long, size long, fp long, keys array<long>"), "prints")
    named = prints.where("size > 0").select("node", "size", "fp", "keys", F.struct("_id", "_text_hash").alias("one"))
    nodes = stored(named.dropDuplicates(["node"]), "nodes")
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    often = stored(rows.groupBy("key").agg(F.count("*").alias("count"), F.min("node").alias("first"))
                   .where("count > 1").select("key", "first"), "often")
    shared = stored(rows.join(often, "key"), "shared")
    pairs = stored(shared.where(F.col("node") != F.col("first"))
                   .select(F.col("first").alias("a"), F.col("node").alias("b")).union(_printed_alike(nodes)).distinct(),
                   "pairs")
    # Texts are read again only for nodes that are compared.
    asked = shared.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = nodes.join(asked, "node").select("node", "one._id", "one._text_hash")
    texts = keyed(docs)
    sets = stored(texts.join(wanted, on_key(texts, wanted)).select("node", "_text").dropDuplicates(["node"])
                  .mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    links = _links(pairs, sets)
    joined = stored(components(links), "joined")
    placed = stored(shared.join(joined, "node", "left").select(
        "key", "node", "size", F.coalesce("component", "node").alias("component")), "placed")
    more = _open_links(placed, sets)
    if not more.isEmpty():
        joined = stored(components(links.union(more)), "joined")
    return prints.join(joined, "node", "left").select(
        F.col("_id").alias("doc_id"), "_text_hash", F.coalesce("component", "node").alias("_component"))
