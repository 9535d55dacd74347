"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.llm import (bpe, decontaminate, embeddings, fim, languages, licenses, quality, simhash, suffixes,
                          toxicity, units, urls, whitening)
from zonetide.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return found.select("doc_id", "n_units", "n_removed", "removed_bytes",
                        F.array_join(spans, ",").alias("spans"), F.col("text").alias("kept_text"))


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), tiles AS (
  SELECT doc_id, text,
         regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}][^.!?\n]*[^0-9A-Za-z\x{80}-\x{10FFFF}]*') AS t,
         regexp_extract(text, '^[^0-9A-Za-z\x{80}-\x{10FFFF}]*') AS head
  FROM docs
), units AS (
  SELECT doc_id, strlen(head) AS head_bytes, unnest(t) AS tile, generate_subscripts(t, 1) AS place
  FROM tiles
), cleaned AS (
  SELECT *, trim(regexp_replace(translate(tile, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz'),
                                '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')) AS norm,
         head_bytes + coalesce(sum(strlen(tile)) OVER before, 0) AS start_byte,
         coalesce(sum(CASE WHEN contains(tile, chr(10)) THEN 1 ELSE 0 END) OVER before, 0) AS line
  FROM units
  WINDOW before AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ranked AS (
  SELECT *, len(string_split(norm, ' ')) AS words,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS repeated
  FROM cleaned
), lined AS (
  SELECT *, bool_and(repeated) OVER (PARTITION BY doc_id, line) AS whole,
         place - row_number() OVER (PARTITION BY doc_id, repeated ORDER BY place) AS run
  FROM ranked
), decided AS (
  SELECT *, repeated AND (bool_or(whole) OVER r OR sum(words) OVER r >= 8) AS goes
  FROM lined WINDOW r AS (PARTITION BY doc_id, repeated, run)
), spans AS (
  SELECT doc_id, run, min(start_byte) AS a, max(start_byte + strlen(tile)) AS b
  FROM decided WHERE goes GROUP BY doc_id, run
), listed AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, sum(b - a) AS removed_bytes
  FROM spans GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE goes) AS n_removed,
         string_agg(tile, '' ORDER BY place) FILTER (WHERE NOT goes) AS rest
  FROM decided GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_units, 0)::BIGINT AS n_units, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       coalesce(l.removed_bytes, 0)::BIGINT AS removed_bytes, coalesce(l.spans, '') AS spans,
       d.head || coalesce(c.rest, '') AS kept_text
FROM tiles d LEFT JOIN counted c USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.default_vocabulary()
    encoded = bpe.encode(docs, vocabulary, bpe.frequent_lexicon(docs, vocabulary))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                      table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), tokens AS (
  SELECT *, regexp_extract_all(text, '[ 	-]*[^ 	-]+|[ 	-]+') AS t,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM docs
), cut AS (
  SELECT *, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
           AS plain, h4 % 100 < 80 AS spm
  FROM tokens
), parts AS (
  SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle,
         array_to_string(t[b + 1:], '') AS suffix
  FROM cut
)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.predict(docs.select("doc_id", "text"), languages.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = [value for name, value in globals().items()
             if name.startswith("op") and callable(value) and value.__module__ == __name__]
    return {query.__name__: query for query in sorted(found, key=lambda q: int(q.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op11_fill_in_middle": OP11_SQL}
