"""Near-duplicate embeddings: a small-world graph per shard, every shard queried, links verified.

Equal vectors of a label are one node. The nodes of a label are dealt over shards of bounded size.
Each shard builds a graph of its nodes (see ``hnsw``) and audits it: for some nodes all links to others are computed
directly, and the search beam is widened until the graph finds enough of them. Then all nodes of the label,
in blocks as they stream by, are looked up in it; some of each block from other shards are audited too. Links found are verified in double precision; components
are joined over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import partitions, stored
from zonetide.llm.components import components
from zonetide.llm.hnsw import BEAM, Graph

COSINE = 0.93
SHARD = 16_384       # nodes of a graph, about
AUDITED = 256        # nodes of each shard, at least, whose links are computed directly
AUDITED_LINKS = 200  # links that an audit should rest on
AUDITED_QUERIES = 64  # queries of each block from other shards that are audited
LEAST_RECALL = 0.98  # of the audited links, found by the graph
SLACK = 1e-4         # single precision may be off by less


def _unit(vectors: np.ndarray) -> np.ndarray:
    """In two steps, so that very large and very small numbers neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def links_found(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float, beam: int) -> tuple[int, int]:
    """How many links the queries have and how many of them the graph finds; a node's match with itself (``own``, -1
    for queries from elsewhere) is no link."""
    rows = np.arange(len(queries))
    near = queries @ graph.vectors.T >= least
    near[rows[own >= 0], own[own >= 0]] = False
    query, node = graph.within(queries, least, beam)
    return int(near.sum()), int((near[query, node]).sum())


def audited_beam(graph: Graph, nodes: np.ndarray, least: float) -> int:
    """The beam at which the graph finds enough of the links of the nodes with the smallest hashes: of as many as it takes
    to have ``AUDITED_LINKS`` links, or all."""
    order = np.argsort(nodes, kind="stable")
    size, beam = min(AUDITED, len(order)), BEAM
    while True:
        sample = order[:size]
        true, found = links_found(graph, graph.vectors[sample], sample, least, beam)
        if true >= AUDITED_LINKS or size == len(order):
            break
        size = min(4 * size, len(order))
    while found < LEAST_RECALL * true and beam < len(graph.vectors):
        beam *= 2
        _, found = links_found(graph, graph.vectors[sample], sample, least, beam)
    return beam


class _Shard:
    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, least: float):
        self.nodes, self.exact, self.least = nodes, _unit(vectors), least
        self.graph = Graph(self.exact.astype(np.float32))
        self.beam = audited_beam(self.graph, nodes, least - SLACK)

    def audit(self, nodes: np.ndarray, queries: np.ndarray) -> None:
        """Widens the beam for this and later blocks until it finds enough of the links of some queries from other shards."""
        foreign = np.flatnonzero(~np.isin(nodes, self.nodes))
        sample = foreign[np.argsort(nodes[foreign], kind="stable")[:AUDITED_QUERIES]]
        none = np.full(len(sample), -1)
        while len(sample) and self.beam < len(self.nodes):
            true, found = links_found(self.graph, queries[sample], none, self.least - SLACK, self.beam)
            if found >= LEAST_RECALL * true:
                break
            self.beam *= 2

    def links(self, nodes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        queries = _unit(vectors)
        self.audit(nodes, queries.astype(np.float32))
        query, node = self.graph.within(queries.astype(np.float32), self.least - SLACK, self.beam)
        out = []
        for at in range(0, len(query), 1 << 16):
            q, n = query[at:at + (1 << 16)], node[at:at + (1 << 16)]
            cosine = np.einsum("nd,nd->n", queries[q], self.exact[n])
            good = (cosine >= self.least) & (nodes[q] != self.nodes[n])
            out.append(np.stack([nodes[q][good], self.nodes[n][good]], axis=1))
        pairs = np.concatenate([*out, np.zeros((0, 2), np.int64)])
        pairs.sort(axis=1)
        return np.unique(pairs, axis=0)


def _search(least: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; in each shard its own nodes come first, then the queries."""
        place, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("place").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False)
            nodes = batch.column("node").to_numpy()
            vectors = batch.column("vector")
            change = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *change], [*change, len(numbers)], strict=True):
                mine = vectors.slice(low, high - low)
                values = mine.flatten().to_numpy().astype(np.float64).reshape(high - low, -1)
                if numbers[low] != place:
                    place, held, shard = numbers[low], [], None
                if not query[low]:
                    held.append((nodes[low:high], values))
                    continue
                if shard is None:
                    shard = _Shard(np.concatenate([h[0] for h in held]),
                                   np.concatenate([h[1] for h in held]), least)
                    held = []
                pairs = shard.links(nodes[low:high], values)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                                 names=["a", "b"])
    return search


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, shard_size: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Vectors of equal labels link where their cosine reaches ``cosine``; those with a null label, or that are null,
    empty, zero or hold a null or non-finite component, link with nothing, nor do vectors of different length.
    ``n_links`` counts the other rows linked directly, equal ones included, ``component_id`` is the smallest
    ``vec_id`` reachable, ``kept`` tells whether it is the row's own. A null ``vec_id`` is larger than all
    others; a row with one is kept only if its component has no other.
    """
    vector = embeddings["embedding"].cast("array<double>")
    sound = (embeddings["label"].isNotNull() & vector.isNotNull()
             & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & F.exists(vector, lambda x: x != 0))
    group = F.concat_ws(":", embeddings["label"].cast("string"), F.size(vector).cast("string"))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), vector.alias("vector"),
                             F.when(sound, group).alias("group"))
    # Zeros of either sign are equal; adding 0.0 makes them one for the hash as well.
    same = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("vector", same).withColumn(
        "node", F.when(F.col("group").isNotNull(), F.xxhash64("group", "vector")))
    nodes = stored(rows.where(F.col("group").isNotNull()).groupBy("node", "group", "vector")
                   .agg(F.min("vec_id").alias("first"), F.count("*").alias("rows")), "nodes")
    shards = stored(nodes.groupBy("group").agg(
        F.ceil(F.count("*") / shard_size).cast("int").alias("shards")), "shards")
    dealt = nodes.select("node", "group", "vector").join(shards, "group")
    own = dealt.select("node", "vector", "group", F.lit(False).alias("query"),
                       F.pmod("node", "shards").cast("int").alias("shard"))
    asked = dealt.select("node", "vector", "group", F.lit(True).alias("query"),
                         F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    placed = own.union(asked).select(F.xxhash64("group", "shard").alias("place"), "query", "node", "vector")
    links = stored(placed.repartition(partitions(embeddings.sparkSession), "place")
                   .sortWithinPartitions("place", "query")
                   .mapInArrow(_search(cosine), "a long, b long").distinct(), "links")
    both = links.union(links.select("b", "a"))
    counts = (both.join(nodes.select(F.col("node").alias("b"), "rows"), "b")
              .groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("others")))
    linked = stored(components(links), "linked")
    names = (linked.join(nodes.select("node", "first"), "node")
             .groupBy("component").agg(F.min("first").alias("name")))
    # Stored, so that the join below can split a vector that very many rows share.
    found = stored(nodes.select("node", "first", "rows").join(counts, "node", "left")
                   .join(linked.join(names, "component"), "node", "left")
                   .select("node", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                           F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("name"))
                           .alias("component_id")), "found")
    joined = rows.select("vec_id", "node").join(found, "node", "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))
