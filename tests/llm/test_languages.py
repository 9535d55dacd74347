"""Cross-parsing against plain substring search, and accuracy on held-out rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from zonetide.llm import languages
from zonetide.llm.common import table
from zonetide.llm.suffix_automaton import Parser, suffix_automaton


def phrases(text: bytes, sample: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


@given(st.lists(st.text(alphabet="abc\x00", max_size=30), min_size=1, max_size=3),
       st.lists(st.text(alphabet="abcd", max_size=25), max_size=6))
@settings(max_examples=80, deadline=None)
def test_phrases_agree_with_substring_search(samples, texts):
    parser = Parser([suffix_automaton(s.encode()) for s in samples], 0)
    data = "".join(texts).encode()
    lengths = np.array([len(t) for t in texts], np.int64)
    found = parser.phrases(parser.symbol[np.frombuffer(data, np.uint8)], np.cumsum(lengths) - lengths, lengths)
    assert found.tolist() == [[phrases(t.encode(), s.encode()) for t in texts] for s in samples]


def test_automaton_is_no_larger_than_it_may_be():
    text = b"abracadabra" * 20
    source, _, target = suffix_automaton(text)
    assert target.max() < 2 * len(text) and len(source) < 3 * len(text)



@given(st.lists(st.text(alphabet="aBé1 .\nİ日", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_normalised(texts):
    data, places = languages.normalised(languages.lower(pa.array(texts, pa.string())))
    for row, text in enumerate(texts):
        lowered = languages.lower(pa.array([text], pa.string()))[0].as_py()
        expected = re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", lowered)
        # Blanks at the end of a text may stay or go; they change at most one phrase.
        assert bytes(data[places[row]:places[row + 1]]).decode().rstrip() == expected.rstrip()


def test_predictions_by_brute_force():
    samples = {"x": ["the quick brown fox jumps over the lazy dog"], "y": ["der schnelle braune fuchs springt"]}
    model = languages.fit(samples)
    texts = ["the dog", "der fuchs", "quick", "ÜBER", "springt the", None, "", "12 .", "日本"]
    found, score = model.predictions(pa.array(texts, pa.string()))
    for text, language, value in zip(texts, found, score, strict=True):
        if not text or text == "12 .":
            assert (language, value) == ("und", 0)
            continue
        read = languages.normalised(languages.lower(pa.array([text])))[0].tobytes()
        bits = {k: phrases(read, v[0].encode()) * np.log2(len(v[0]) + 1) for k, v in samples.items()}
        best = min(sorted(bits), key=bits.get)
        assert language == best and abs(value - (1 - bits[best] / max(bits.values()))) < 1e-12


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = languages.predict(docs, languages.train(docs)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_nothing_of_held_out_rows(spark, documents):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    docs = documents([(i, "some text here") for i in ids])
    assert languages.train(docs).languages == ()
    assert {(r.lang_pred, r.score) for r in languages.predict(docs, languages.train(docs)).collect()} == {("und", 0.0)}


def test_awkward_rows_and_columns(spark, awkward):
    docs = awkward.drop("lang").selectExpr("*", "if(doc_id = 5, 'xx', 'en') AS lang", "'q' AS _whole")
    model = languages.train(docs)
    rows = languages.predict(docs, model).collect()
    assert len(rows) == 9 and {r._whole for r in rows} == {"q"}
    assert all((r.lang_pred == "und") == (not (r.text or "").strip()) for r in rows)
    assert languages.predict(docs.limit(0), model).collect() == []
    assert languages.train(docs.limit(0)).languages == ()


def test_blocks_of_a_very_long_text(spark, documents):
    sample = "the quick brown fox jumps over the lazy dog "
    model = languages.fit({"x": [sample], "y": ["der schnelle braune fuchs springt "]})
    rows = languages.predict(documents([sample * 100_000, sample]), model).collect()
    assert {r.lang_pred for r in rows} == {"x"}
