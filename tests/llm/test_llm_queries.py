"""The registered queries and the pipeline."""

from pathlib import Path

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from zonetide.llm import queries


def test_thirteen_queries_and_the_pipeline_are_registered():
    names = entry.queries().keys()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and [name for name, _ in corpus_pipeline.STAGES][-1] == "bpe"


def test_sql_agrees(spark):
    duck = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    for name, sql in queries.oracle_sql().items():
        found, expected = queries.queries()[name](spark, SF), duck.sql(sql)
        assert found.columns == expected.columns
        assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


def test_stages_keep_the_columns_and_take_awkward_rows(spark, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "other words of a longer test item here now")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = awkward
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if number < 4:
            assert docs.columns == awkward.columns, name
    assert sorted(r.doc_id for r in docs.collect()) == [1, 1, 2, 5]
