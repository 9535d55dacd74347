"""Substring dedup by hashed units."""

import pyarrow as pa

from zonetide.llm import units
from zonetide.llm.common import slices

LINE = "The quick brown fox jumps over the lazy dog today."
PASSAGE = "One two three four five. Six seven eight nine ten, eleven twelve."


def kept(docs, **options):
    return {r["doc_id"]: r for r in units.remove_repeats(docs, **options).collect()}


def test_repeats_go_and_the_earliest_stays(documents):
    docs = documents([f"First line.\n{LINE}\nOther words here.", f"{LINE}\nNew text.",
                      f"Something else. {PASSAGE} End of this.", f"Quite new: {PASSAGE} Finis.",
                      f"x. {PASSAGE.upper()} y."])
    rows = kept(docs)
    assert rows[0]["text"] == f"First line.\n{LINE}\nOther words here."
    assert rows[1]["text"] == "New text."
    assert rows[1]["removed_spans"][0].asDict() == {"start": 0, "end": len(LINE) + 1}
    assert PASSAGE in rows[2]["text"]
    # The first sentence is led by other words there, the second is the passage's own.
    assert rows[3]["text"].startswith("Quite new")
    assert rows[4]["text"] == "x. y."
    assert rows[4]["removed_bytes"] == len(PASSAGE) + 1


def test_short_shared_sentences_stay(documents):
    rows = kept(documents(["And so. It began long ago.", "He came. And so. We went away."]))
    assert rows[1]["n_removed"] == 0
    assert kept(documents(["And so. It began.", "He came. And so. We went."]),
                min_words=1)[1]["text"] == "He came. We went."


def test_nulls_ties_empty_texts_and_clashing_columns(spark, documents):
    docs = documents([(3, LINE), (3, LINE), (None, LINE), (1, None), (2, ""), (4, "...\n\n!"),
                      (5, f"É. {LINE}\n")]).withColumnRenamed("lang", "n_units")
    rows = units.remove_repeats(docs).collect()
    assert len(rows) == 7
    by_id = {(r["doc_id"], i): r for i, r in enumerate(sorted(rows, key=lambda r: str(r["doc_id"])))}
    texts = {k[0]: r["text"] for k, r in by_id.items()}
    assert texts == {3: LINE, None: "", 1: "", 2: "", 4: "...\n\n!", 5: "É. "}
    assert units.remove_repeats(docs.limit(0)).collect() == []


def test_cutting_a_batch_that_is_part_of_a_larger_one():
    texts = [f"É {i} ü. {LINE} ñ {i}." for i in range(9)]
    whole = pa.RecordBatch.from_arrays(
        [pa.array([{"x": 1}] * 9), pa.array(texts), pa.array([[1]] * 9, pa.list_(pa.int32()))],
        names=["_row", "_text", "places"])
    out = []
    for batch in slices([whole], "_text", 150):
        found = units.Units(batch.column("_text"))
        goes = (found.rows[found.row] + 1) == range(len(found.row))
        out += units._without(batch, found, goes).column("_text").to_pylist()
    assert out == [f"É {i} ü. ñ {i}." for i in range(9)]


def test_a_very_long_text(documents):
    text = " ".join(f"Sentence number {i} is not repeated at all here." for i in range(20_000))
    rows = kept(documents([text, text + " And more follows in this one."]))
    assert rows[0]["n_removed"] == 0 and rows[1]["text"] == "And more follows in this one."
