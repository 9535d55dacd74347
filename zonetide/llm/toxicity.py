"""Toxicity by compression distance.

Two zstandard dictionaries are learned from labelled texts: one of the most frequent words of
ordinary text, one of the strings that recur in toxic text but not in ordinary text. Each
word of a document, with the spaces around it, is a window. A window that compresses to fewer bytes
with the toxic dictionary than with the ordinary one speaks for toxicity; how many bytes it takes, and
how many strings the toxic dictionary keeps, is calibrated on the labelled texts.

Nulls and empty texts score as texts without windows (lowest score). Repeated rows each get
their score. Without labels of both classes nothing can be learned and every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import Words, held_out, labelled_sample, per_row, slices, text_of, unused_name

SAMPLE_PER_CLASS = 1000      # labelled documents learned from, at most, of each class
SAMPLE_BYTES = 20_000        # longer texts aren't learned from
ORDINARY_BYTES = 32 << 10    # size of the ordinary dictionary
LEAST_ODDS = 20              # so many times more frequent in toxic documents
LEAST_SHARE = 0.01           # of the toxic documents have the string
WRONG_COSTS = 3              # a clean document called toxic, in toxic documents missed
KEPT_STRINGS = (8, 16, 32, 64, 128)
# The compressor looks for matches only where some bytes follow, the same for both dictionaries.
FILLER = b"\0" * 32

_WORKER_CACHE: dict[bytes, dict] = {}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=17, chain_log=17,
        search_log=6, target_length=16, write_content_size=False, write_checksum=False,
        write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content + b"\n" * 16,
                                               dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def sizes(content: bytes, words: list[bytes]) -> np.ndarray:
    """Compressed bytes of each window with a dictionary of this content."""
    compress = _compressor(content).compress
    return np.array([len(compress(b" " + word + b" " + FILLER)) for word in words], np.int64)


def gains(ordinary: bytes, toxic: bytes, words: list[bytes]) -> list[int]:
    """Bytes that each window saves with the toxic instead of the ordinary dictionary."""
    return (sizes(ordinary, words) - sizes(toxic, words)).tolist()


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float  # bytes that a toxic window saves

    def score(self, most: np.ndarray, share: np.ndarray) -> np.ndarray:
        """From the largest gain of a document and the share of windows at the threshold."""
        if not self.toxic:
            return np.zeros(len(most))
        margin = most - self.threshold + 0.5 + np.minimum(share * 10, 0.4)
        return 1 / (1 + np.exp(-2 * margin))


def _documents(texts: list[str]) -> list[list[bytes]]:
    words = Words(pa.array(texts, pa.large_string()))
    return [sorted({words.word(i) for i in range(words.rows[d], words.rows[d + 1])})
            for d in range(len(texts))]


def _strings(counts: Counter) -> Counter:
    """In how many documents the beginnings of words occur, a space before them."""
    found: Counter = Counter()
    for word, n in counts.items():
        window = b" " + word + b" "
        for size in range(5, min(len(window), 24) + 1):
            found[window[:size]] += n
    return found


def fit(sample: list[tuple[str, int]]) -> Model:
    """Learns both dictionaries and the threshold from (text, 1 if toxic) pairs."""
    toxic = _documents([text for text, label in sample if label == 1])
    ordinary = _documents([text for text, label in sample if label == 0])
    if not toxic or not ordinary:
        return Model(b"", b"", 0.0)
    # Every other document only calibrates, so that strings of a few copies gain nothing.
    check_toxic, check_ordinary = toxic[1::2] or toxic, ordinary[1::2] or ordinary
    toxic, ordinary = toxic[::2], ordinary[::2]
    in_toxic = Counter(word for document in toxic for word in document)
    in_ordinary = Counter(word for document in ordinary for word in document)
    here, there = _strings(in_toxic), _strings(in_ordinary)
    least = max(2, LEAST_SHARE * len(toxic))
    telling = {s: n for s, n in here.items() if n >= least
               and n / len(toxic) >= LEAST_ODDS * (there[s] + 0.5) / max(len(ordinary), 10)}
    kept: list[bytes] = []
    for string in sorted(telling, key=lambda s: (-telling[s] * len(s), s)):
        bare = string.strip()
        if not any(bare in k or k.strip() in string for k in kept):
            kept.append(string)
        if len(kept) == KEPT_STRINGS[-1]:
            break
    # The strings used most come last, where offsets are cheapest.
    frequent = b""
    for word, _ in sorted(in_ordinary.items(), key=lambda x: (-x[1], x[0])):
        if len(frequent) + len(word) >= ORDINARY_BYTES:
            break
        frequent = b" " + word + frequent
    frequent += b" "

    best = (-9.0, 0, Model(frequent, b"", 0.0))
    vocabulary = sorted({word for d in (*check_toxic, *check_ordinary) for word in d})
    plain = sizes(frequent, vocabulary)
    # Sizes up to the first that holds all strings.
    tried = [n for i, n in enumerate(KEPT_STRINGS) if kept and (not i or KEPT_STRINGS[i - 1] < len(kept))]
    for size in tried:
        content = b"".join(reversed(kept[:size]))
        gain = dict(zip(vocabulary, (plain - sizes(content, vocabulary)).tolist(), strict=True))
        most = [np.array([max((gain[w] for w in d), default=-99) for d in documents])
                for documents in (check_toxic, check_ordinary)]
        worth = []
        for threshold in range(1, 9):
            found, wrong = ((m >= threshold).mean() for m in most)
            worth.append(found - WRONG_COSTS * wrong)
        if max(worth) > best[0] + 1e-9:
            # Of thresholds that do as well, the middle one.
            good = [t for t, w in enumerate(worth, 1) if w >= max(worth) - 1e-9]
            best = (max(worth), size, Model(frequent, content, float(good[len(good) // 2])))
    return best[2]


def train(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from at most ``at_most`` labelled documents of each class, none of them held out."""
    return fit(labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id"), 5, 0),
                               at_most, SAMPLE_BYTES))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1), ``toxic_windows`` and ``windows`` to the documents.
    Columns of these names are replaced, all others are kept. Texts of any length are read whole."""
    added = ("score", "toxic_windows", "windows")
    kept = docs.drop(*added)
    schema = kept.withColumns({"score": F.lit(0.0), "toxic_windows": F.lit(0).cast("long"),
                               "windows": F.lit(0).cast("long")}).schema
    whole = unused_name(kept, "whole")
    names = [*kept.columns, *added]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WORKER_CACHE.setdefault(model.toxic + model.ordinary, {})
        for batch in slices(batches, whole):
            words = Words(batch.column(whole))
            gain = words.per_word(cache, lambda w: gains(model.ordinary, model.toxic, w))
            hits = (gain >= model.threshold).astype(np.int64)
            total = np.diff(words.rows)
            toxic = per_row(np.add, hits, words.rows, 0).astype(np.int64)
            values = model.score(per_row(np.maximum, gain, words.rows, -99),
                                 toxic / np.maximum(total, 1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(values), pa.array(toxic), pa.array(total.astype(np.int64))],
                names=names)

    return kept.withColumn(whole, text_of(docs, text)).mapInArrow(scored, schema)


def filter_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, with their own columns."""
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
                       text_of(docs).alias("text"))
    return score(wide, model).where(F.col("score") < threshold).select("_row.*")
