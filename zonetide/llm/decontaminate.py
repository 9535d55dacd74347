"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words of the benchmark are counted once over all documents. Seeds are triples of an item's words: neighbours, or with one
word left out between them; documents are looked through for triples of the same kinds, so a word put in, left out or
replaced inside a triple doesn't hide it. An alignment that reaches the score wanted has such a triple if words were only
put in: there are then fewer than 0.8 of them for each of the item's, so some three in a row have at most one between them.

A triple is rare if, were words drawn independently, it would turn up less than once in a corpus of that size; how often
copies of the benchmark really occur plays no part, so a passage copied into a third of all documents keeps its seeds. All rare
triples are seeds, and of every stretch of an item the rarest ones, however common, so that no item loses its
seeds as the corpus grows. Where a seed occurs in a document, the item is aligned with the words around it: equal words score,
others and gaps cost. Long items are aligned in parts, and the parts' alignments are chained in order; the score is
always a share of the whole item.

The benchmark is worked on in blocks of bounded size, each against all documents, so what is
broadcast doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import STEP, Words, mixed, slices, stored, text_of

SEED_WORDS = 3
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # places of a seed's words
STRETCH = 6              # places of an item, the rarest seed of each pattern of which is kept in any case
BLOCK_ITEMS = 20_000     # items that are broadcast at once
PART_WORDS = 500         # longer items are aligned in parts of about this many words
FILTER_BITS = 22         # of a table that tells most words apart from seeds
LEAST_SCORE = 0.6        # of the score of the item aligned with itself
LEAST_WORDS = 8          # shorter items have to occur whole
MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 4 << 20          # cells of alignment tables held at once
HITS_AT_ONCE = 1 << 18

_FOUND = "doc_id long, item_id long, score double, matched int, first_word long, last_word long"


class Items:
    """Words of a block of benchmark items, their n-grams and which of these are rare."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()))
        #: Of each part: its item, its words, its first word in the item; of each item: its id and its number of words.
        self.ids, self.parts, self.item, self.offset, self.lengths = ids, [], [], [], np.diff(words.rows)
        for row in range(len(ids)):
            mine = words.hashes[words.rows[row]:words.rows[row + 1]]
            at = 0
            for part in np.array_split(mine, -(-len(mine) // PART_WORDS)) if len(mine) else []:
                self.parts.append(part)
                self.item.append(row)
                self.offset.append(at)
                at += len(part)
        self.vocabulary = np.unique(np.concatenate([*self.parts, np.zeros(0, np.uint64)]))
        self.sizes = np.array([len(p) for p in self.parts], np.int64)

    def seeds(self, chances: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
        """Hashes of the seeds in order, and the part and place of each. ``chances`` has the logarithm of the share of
        each word of the vocabulary among all."""
        all_hashes, parts, places = [], [], []
        for number, words in enumerate(self.parts):
            chance = chances[np.searchsorted(self.vocabulary, words)]
            for pattern in patterns(len(words)):
                hashes = pattern_hashes(words, pattern)
                n = len(hashes)
                expected = sum(chance[i:i + n] for i in pattern) + np.log(max(total, 1))
                kept = expected < 0
                order = np.lexsort((expected, np.arange(n) // STRETCH))
                kept[order[np.flatnonzero(np.diff(order // STRETCH, prepend=-1))]] = True
                place = np.flatnonzero(kept)
                all_hashes.append(hashes[place])
                parts.append(np.full(len(place), number))
                places.append(place)
        if not all_hashes:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        hashes, part, place = (np.concatenate(x) for x in (all_hashes, parts, places))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], part[order], place[order]


def patterns(size: int) -> list[tuple[int, ...]]:
    """Patterns that a text of this many words has seeds of; fewer than three words are one seed."""
    if size < SEED_WORDS:
        return [tuple(range(size))]
    return [p for p in PATTERNS if p[-1] < size]


def pattern_hashes(words: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at the pattern's places from each word on; equal words have equal ones for any pattern."""
    n = max(len(words) - pattern[-1], 0)
    total = np.zeros(n, np.uint64)
    for i in pattern:
        total = (total + words[i:i + n]) * np.uint64(STEP)
    return mixed(total + np.uint64(len(pattern)))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(batch.column("_text")).hashes).view(np.int64))],
                                         names=["word"])


def _word_counts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(word, n) of the benchmark's words in all documents, and the number of all words (word null): counted once for all
    blocks. A table of leading bits, of one size whatever the benchmark, tells most other words apart in the tasks."""
    asked = stored(items.select(F.col("text").alias("_text")).mapInArrow(_words_of, "word long").distinct(), "asked")
    bits = asked.select(F.shiftrightunsigned("word", 64 - FILTER_BITS).cast("int").alias("bits")).distinct().collect()
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[[r["bits"] for r in bits]] = True  # 2 ** FILTER_BITS at most
    shared = texts.sparkSession.sparkContext.broadcast(flags)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            hashes = Words(batch.column("_text")).hashes
            some = hashes[shared.value[hashes >> np.uint64(64 - FILTER_BITS)]]
            words, counts = np.unique(some, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words.view(np.int64).tolist(), None], pa.int64()), pa.array([*counts.tolist(), len(hashes)], pa.int64())],
                names=["word", "n"])

    counts = stored(texts.mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    return counts.join(asked, "word").select("word", "n").unionByName(counts.where("word IS NULL"))


def _chances(counts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Logarithms of the shares of a block's words, and the number of all words."""
    total = (counts.where("word IS NULL").first() or {"n": 0})["n"]
    words = counts.sparkSession.createDataFrame(pd.DataFrame({"word": vocabulary.view(np.int64)}), "word long")
    n = np.ones(len(vocabulary), np.int64)
    for row in counts.join(words, "word").collect():  # at most the words of a block
        n[np.searchsorted(vocabulary, np.int64(row["word"]).view(np.uint64))] = row["n"]
    return np.log(n / max(total, 1)), total


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Smith-Waterman of one sequence with each row of ``windows`` (0: no word there), all rows at once:
    (score, matched words, first and last place in the window) of the best local alignment."""
    rows, width = windows.shape
    score = np.zeros((rows, width + 1), np.int32)
    # What a cell's best alignment holds: where it began, and its equal words.
    begin = np.tile(np.arange(width + 1), (rows, 1))
    equal = np.zeros((rows, width + 1), np.int32)
    best = np.zeros(rows, np.int32)
    best_equal, best_begin, best_end = (np.zeros(rows, np.int32), np.zeros(rows, np.int64),
                                        np.zeros(rows, np.int64))
    steps = np.arange(width + 1, dtype=np.int32) * -GAP
    each = np.arange(rows)
    for word in item:
        same = windows == word
        diagonal = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        above = score[:, 1:] + GAP
        cell = np.zeros((rows, width + 1), np.int32)
        cell[:, 1:] = np.maximum(np.maximum(diagonal, above), 0)
        from_above = above > diagonal
        begin_now = np.tile(np.arange(width + 1), (rows, 1))
        equal_now = np.zeros((rows, width + 1), np.int32)
        alive = cell[:, 1:] > 0
        begin_now[:, 1:] = np.where(alive, np.where(from_above, begin[:, 1:], begin[:, :-1]),
                                    begin_now[:, 1:])
        equal_now[:, 1:] = np.where(alive, np.where(from_above, equal[:, 1:],
                                                    equal[:, :-1] + same), 0)
        # Gaps along the window: the best of all cells to the left, less what the gap costs.
        reach = np.maximum.accumulate(cell + steps, axis=1)
        source = np.maximum.accumulate(np.where(cell + steps == reach, np.arange(width + 1), 0), axis=1)
        better = reach - steps > cell
        score = np.where(better, reach - steps, cell)
        begin = np.where(better, np.take_along_axis(begin_now, source, 1), begin_now)
        equal = np.where(better, np.take_along_axis(equal_now, source, 1), equal_now)
        top = score.argmax(axis=1)
        higher = score[each, top] > best
        best = np.where(higher, score[each, top], best)
        best_equal = np.where(higher, equal[each, top], best_equal)
        best_begin = np.where(higher, begin[each, top], best_begin)
        best_end = np.where(higher, top, best_end)
    return best, best_equal, best_begin, best_end - 1


def seed_filter(seed_hash: np.ndarray) -> np.ndarray:
    """Flags of the leading bits that some seed has."""
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[seed_hash >> np.uint64(64 - FILTER_BITS)] = True
    return flags


def _candidates(words: Words, seeds, sizes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(row, part, first word of the window) of the places where seeds meet: one for each row,
    part and diagonal band of the part's size."""
    seed_hash, part, place = seeds
    found = []
    for pattern in sorted({p for size in np.unique(sizes).tolist() for p in patterns(size)}):
        hashes = pattern_hashes(words.hashes, pattern)
        hit = np.flatnonzero(flags[hashes >> np.uint64(64 - FILTER_BITS)])
        low = np.searchsorted(seed_hash, hashes[hit], "left")
        same = seed_hash[np.minimum(low, len(seed_hash) - 1)] == hashes[hit]
        hit, low = hit[same], low[same]
        row = np.searchsorted(words.rows, hit, "right") - 1
        inside = hit + pattern[-1] < words.rows[row + 1]
        hit, row, low = hit[inside], row[inside], low[inside]
        count = np.searchsorted(seed_hash, hashes[hit], "right") - low
        # Seeds of very frequent words hit very often: a bounded number of hits at once.
        upto, done = np.cumsum(count), 0
        while done < len(hit):
            end = max(int(np.searchsorted(upto, (upto[done - 1] if done else 0) + HITS_AT_ONCE, "right")), done + 1)
            some = slice(done, end)
            n = count[some]
            seed = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at, rows = np.repeat(hit[some], n), np.repeat(row[some], n)
            # Where the part would begin; bands overlap, so a window holds the whole alignment.
            start = at - place[seed] - words.rows[rows]
            band = start // np.maximum(sizes[part[seed]], 1)
            found.append(np.unique(np.stack([rows, part[seed], band], axis=1), axis=0))
            done = end
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def chained(offsets: np.ndarray, scores: np.ndarray, equal: np.ndarray, first: np.ndarray, last: np.ndarray
            ) -> tuple[int, int, int, int]:
    """(score, equal words, first and last word) of the best chain of alignments of an item's parts, given in the order of the
    parts: later parts lie later in the document, and words between them cost as gaps do."""
    best, begin, matched = scores.copy(), first.copy(), equal.copy()
    for i in range(len(scores)):
        before = np.flatnonzero((offsets[:i] < offsets[i]) & (last[:i] < first[i]))
        if len(before):
            linked = best[before] + GAP * (first[i] - last[before] - 1)
            top = int(linked.argmax())
            if linked[top] > 0:
                best[i] += linked[top]
                begin[i], matched[i] = begin[before[top]], matched[i] + matched[before[top]]
    end = int(best.argmax())
    return int(best[end]), int(matched[end]), int(begin[end]), int(last[end])


def _aligned(items: Items, words: Words, hits: np.ndarray, least_score: float) -> np.ndarray:
    """(row, part, score, equal words, first and last word in the row) of the alignments at the hits. Of items of one part,
    windows with too few of their words for the score wanted are left out before they are aligned."""
    out = [np.zeros((0, 6), np.int64)]
    for number in np.unique(hits[:, 1]).tolist():
        mine = hits[hits[:, 1] == number]
        size = int(items.sizes[number])
        whole = items.lengths[items.item[number]] == size
        least = (least_score if size >= LEAST_WORDS else 1.0) * size if whole else 0
        width = 3 * size + 2 * SEED_WORDS  # the band, and a part's length on either side
        step = max(1, CELLS // (width * 8))
        for at in range(0, len(mine), step):
            rows, bands = mine[at:at + step, 0], mine[at:at + step, 2]
            first = words.rows[rows] + (bands - 1) * size + size // 2
            where = first[:, None] + np.arange(width)
            valid = (where >= words.rows[rows][:, None]) & (where < words.rows[rows + 1][:, None])
            window = np.where(valid, words.hashes[np.clip(where, 0, len(words.hashes) - 1)], np.uint64(0))
            enough = np.isin(window, items.parts[number]).sum(axis=1) >= least - 1e-9
            rows, first, window = rows[enough], first[enough], window[enough]
            if not len(rows):
                continue
            score, equal, begin, end = align(items.parts[number], window)
            base = first - words.rows[rows]
            out.append(np.stack([rows, np.full(len(rows), number), score, equal, base + begin, base + end], axis=1))
    return np.concatenate(out)


def _search(items: Items, seeds, least_score: float):
    flags = seed_filter(seeds[0])
    item_of, offset_of = np.array(items.item, np.int64), np.array(items.offset, np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            if not len(seeds[0]):
                continue
            words = Words(batch.column("_text"))
            found = _aligned(items, words, _candidates(words, seeds, items.sizes, flags), least_score)
            item = item_of[found[:, 1]]
            order = np.lexsort((found[:, 4], found[:, 1], item, found[:, 0]))
            found, item = found[order], item[order]
            cuts = np.flatnonzero((np.diff(found[:, 0]) != 0) | (np.diff(item) != 0)) + 1
            rows = []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)], strict=True):
                if low == high:
                    continue
                mine = found[low:high]
                size = int(items.lengths[item[low]])
                score, equal, first, last = chained(offset_of[mine[:, 1]], *mine[:, 2:].T)
                share = score / (MATCH * size)
                if share >= (least_score if size >= LEAST_WORDS else 1.0):
                    rows.append((int(mine[0, 0]), items.ids[item[low]], share, equal, first, last))
            if rows:
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()),
                    "item_id": pa.array([r[1] for r in rows], pa.int64()),
                    "score": pa.array([r[2] for r in rows], pa.float64()),
                    "matched": pa.array([r[3] for r in rows], pa.int32()),
                    "first_word": pa.array([r[4] for r in rows], pa.int64()),
                    "last_word": pa.array([r[5] for r in rows], pa.int64())})

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame,
                 least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, matched, first_word, last_word): which documents hold which items.

    ``score`` is that of the best alignment as a share of the item aligned with itself,
    ``matched`` the number of equal words, the places count words of the document from 0.
    Null texts are empty and hold nothing; rows with a null ``doc_id`` come out with
    that; repeated rows give one row, the best. Items that are null or without words are in no
    document, items with equal ids count as one. Items of fewer than eight words have to occur whole. Documents and items
    of any length are taken whole; other columns are not looked at, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("_text"))
    items = stored(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"),
                                    text_of(benchmark).alias("text"))
                   .where(F.col("item_id").isNotNull()).distinct(), "items")
    blocks = -(-items.count() // BLOCK_ITEMS)
    chances, found = stored(_word_counts(texts.select("_text"), items), "chances"), None
    for block in range(max(blocks, 1)):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))) == block)
        rows = sorted((r["item_id"], r["text"]) for r in mine.collect())  # about BLOCK_ITEMS rows
        part = Items([r[0] for r in rows], [r[1] for r in rows])
        search = _search(part, part.seeds(*_chances(chances, part.vocabulary)), least_score)
        here = texts.mapInArrow(search, _FOUND)
        found = here if found is None else found.union(here)
    best = F.struct(F.col("score"), -F.col("first_word"), "matched", "last_word")
    return (found.groupBy("doc_id", "item_id").agg(F.max(best).alias("best"))
            .select("doc_id", "item_id", "best.score", "best.matched",
                    (-F.col("best.col2")).alias("first_word"), "best.last_word"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns. Rows of an id that does are
    judged together; rows with a null id go if any of them holds an item."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_found")), "left_anti")
