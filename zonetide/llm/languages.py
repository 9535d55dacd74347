"""Language identification by cross-parsing: which language's text needs the fewest phrases to spell a document.

For each language a suffix automaton holds a sample of its labelled text. A document is cut greedily into the longest
phrases that occur in that sample; their number times the bits of a place in the sample, by the length of the document,
estimates the cross entropy. The language of the least estimate wins, ties go to the value first in order.

Texts are compared as UTF-8 in lower case, with every run of ASCII characters other than letters as one blank. A document
is parsed in blocks of ``BLOCK`` bytes, where phrases end, so that a very long text takes no more memory at a time than
many short ones. Documents don't depend on each other; scoring has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from zonetide.llm.common import flat, held_out, per_row, slices, text_of, unused_name
from zonetide.llm.suffix_automaton import Parser, suffix_automaton

SAMPLE_BYTES = 131_072  # learned from at most, all languages together
LANGUAGES = 256         # at most; the most frequent ones are learned
PIECE = 256             # characters taken of a document to learn from
BLOCK = 512             # bytes of a text parsed in one go
UNKNOWN = "und"
_SEPARATOR = 0          # between pieces; no phrase holds it

_LOWER_LETTER = np.zeros(256, bool)
_LOWER_LETTER[97:123] = True
_KEPT = np.zeros(256, bool)
_KEPT[[*range(97, 123), *range(128, 256)]] = True


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lower-case texts as they are compared, and where each text's begin and the last one's end."""
    data, bounds = flat(texts)
    letter = _KEPT[data]
    stays = letter.copy()
    stays[:-1] |= letter[1:]  # of a run of others, the last one stays, as a blank
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    stays[ends] = letter[ends]
    places = np.concatenate(([0], np.cumsum(stays)))[bounds]
    return np.where(letter, data, np.uint8(32))[stays], places


def with_letters(texts: pa.Array) -> np.ndarray:
    """Which lower-case texts hold a letter of any script."""
    data, bounds = flat(texts)
    found = per_row(np.logical_or, _LOWER_LETTER[data], bounds, False).astype(bool)
    wide = per_row(np.logical_or, data > 127, bounds, False).astype(bool)
    for row in np.flatnonzero(wide & ~found).tolist():
        found[row] = any(map(str.isalpha, texts[row].as_py()))
    return found


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    automata: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    bits: np.ndarray  # of a place in each language's sample

    @cached_property
    def parser(self) -> Parser:
        """Put together where it is used; only the transitions travel."""
        return Parser(self.automata, _SEPARATOR)

    def entropies(self, texts: pa.Array) -> np.ndarray:
        """Bits a byte by language (rows) and text; infinite for texts without any byte left."""
        data, places = normalised(texts)
        sizes = np.diff(places)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = places[row] + number * BLOCK
        lengths = np.minimum(sizes[row] - number * BLOCK, BLOCK)
        phrases = self.parser.phrases(self.parser.symbol[data], starts, lengths)
        total = np.zeros((len(self.languages), len(sizes)))
        for language, counts in enumerate(phrases):
            total[language] = np.bincount(row, counts, len(sizes))
        return np.where(sizes > 0, total * self.bits[:, None] / np.maximum(sizes, 1), np.inf)

    def predictions(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: by how much of the runner-up's entropy the winner's is less."""
        texts = lower(texts)
        known = with_letters(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        entropy = self.entropies(texts)
        best = entropy.argmin(axis=0)
        least = np.sort(entropy, axis=0)
        score = np.ones(len(texts))
        if len(self.languages) > 1:
            score[known] = 1 - least[0, known] / least[1, known]
        found = [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
        return found, np.where(known, np.clip(score, 0, 1), 0.0)


def fit(samples: dict[str, list[str]]) -> Model:
    """Learns from pieces of text by language. Languages without any letter in their pieces are left out."""
    automata, bits, languages = [], [], []
    for language in sorted(samples):
        pieces = lower(pa.array(samples[language], pa.large_string()))
        data, places = normalised(pieces)
        raw = data.tobytes()
        text = bytes([_SEPARATOR]).join(raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True))
        if with_letters(pieces).any():
            languages.append(language)
            automata.append(suffix_automaton(text))
            bits.append(np.log2(len(text) + 1))
    return Model(tuple(languages), automata, np.array(bits))


def train(docs: DataFrame, at_most: int = SAMPLE_BYTES, most_languages: int = LANGUAGES) -> Model:
    """Learns the values of ``lang`` from rows with a text, a language and a ``doc_id`` that aren't held out.

    Of each language, different texts with the smallest hashes of their ids give a piece each, up to ``at_most`` bytes for all
    languages together. Rows are thinned out by their hashes before any shuffle, so no language is sorted as a whole.
    """
    place = F.abs(F.xxhash64("text", "doc_id") % F.greatest(F.length("text") - PIECE, F.lit(1))).cast("int")
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
                        docs["text"].cast("string").alias("text"))
            .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "")
                   & ~held_out(F.col("doc_id"), 4, 2)))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return fit({})
    each = at_most // len(counts)
    pieces = max(each // PIECE, 1)
    # Four times as many as needed, since copies give one piece only.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(4.0 * pieces / r["count"], 1.0))])
    hashed = rows.withColumn("hash", F.xxhash64("doc_id"))
    chosen = hashed.where(F.abs(F.col("hash") / 2.0 ** 63) <= F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    first = Window.partitionBy("lang").orderBy("hash", "doc_id", "piece")
    sample = (chosen.select("lang", "hash", "doc_id", F.xxhash64("text").alias("same"),
                            F.substring("text", place + 1, F.lit(PIECE)).alias("piece"))
              .withColumn("copy", F.row_number().over(Window.partitionBy("lang", "same").orderBy("hash", "doc_id")))
              .where("copy = 1").withColumn("number", F.row_number().over(first)).where(F.col("number") <= pieces)
              .select("lang", "number", "piece").collect())
    found: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["number"])):
        found.setdefault(row["lang"], []).append(row["piece"])
    return fit(found)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to the documents; columns of those names are replaced.

    Null texts and those without a letter get ``und`` and 0, as does everything if no language was learned. If one was
    learned, all others get it with 1. A text none of whose bytes was learned goes to the language first in order of those
    with the smallest sample. Repeated rows get equal results, very long texts are read to their end, no rows give no rows.
    """
    kept = docs.drop("lang_pred", "score")
    names = [*kept.columns, "lang_pred", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 100 bytes for each byte of the sample

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            found, score = shared.value.predictions(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score)],
                                             names=names)

    schema = StructType([*kept.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*[docs[c] for c in kept.columns], text_of(docs, text).alias(unused_name(kept, "whole"))
                       ).mapInArrow(predicted, schema)
