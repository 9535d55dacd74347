"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonetide.llm import fim
from zonetide.llm.wavelet import WaveletMatrix

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, seed=42, rate=50, spm_rate=80):
    """(n, form, prefix_chars, middle_chars, output)."""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.lists(st.integers(0, 7), max_size=300))
@settings(max_examples=40, deadline=None)
def test_ranks(codes):
    codes = np.array(codes, np.uint8)
    matrix = WaveletMatrix(codes, 3)
    at = np.arange(len(codes) + 1)
    for code in range(8):
        assert matrix.rank(code, at).tolist() == [int((codes[:i] == code).sum()) for i in at]


@given(st.lists(st.text(alphabet=" \t\n\x0b\x1cab<>PSMé日🙂", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_cuts_of_a_batch(texts):
    tokens = fim.Tokens(pa.array(texts, pa.string()))
    words = [TOKEN.findall(t) for t in texts]
    assert tokens.counts.tolist() == [len(w) for w in words]
    assert tokens.marked().tolist() == [any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts]
    for take in (0, 1, 2, 100):
        asked = np.minimum(take, tokens.counts)
        places = tokens.place(asked)
        for row, place in enumerate(places):
            prefix = "".join(words[row][:take])
            assert bytes(tokens.data[tokens.bounds[row]:place]).decode() == prefix
            assert tokens.code_points(tokens.bounds[:-1], places)[row] == len(prefix)


def test_all_forms_agree_with_plain_python(spark, documents):
    texts = ["one two  three\n", "é ü 日本 🙂 <|endoftext|>", "x", " ", "a<b <P <S> c", "<P>", "<PS> <<M >",
             "tail  ", "\x0b\x0cmixed\r\nends"] * 12
    rows = {(r.doc_id): r for r in fim.rearrange(documents(texts), rate=90).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(i, text, rate=90), text
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


def test_every_output_gives_its_text_back(spark, documents):
    texts = ["<", "<S", "> a <P", "M> <", "word word word", ""] * 20
    found = fim.rearrange(documents(texts), rate=100)
    back = found.select("text", fim.restored(F.col("output"), F.col("form")).alias("back"), "form").collect()
    assert all(r.text == r.back for r in back) and sum(r.form != "plain" for r in back) >= 90


def test_awkward_rows_and_columns(spark, awkward):
    docs = awkward.selectExpr("*", "7 AS n", "'q' AS _whole", "8 AS _number", "'o' AS output")
    rows = fim.rearrange(docs).collect()
    assert len(rows) == 9 and {(r._whole, r._number, r.score) for r in rows} == {("q", 8, "x")}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text or "")


def test_empty_table_and_very_long_text(spark, documents):
    assert fim.rearrange(documents([])).collect() == []
    long = "wörd  " * 1_500_000 + "end"
    ids = [i for i in range(20) if expected(i, "a b")[1] != "plain"][:2]
    for r in fim.rearrange(documents([(i, long) for i in ids])).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, long)


@pytest.mark.parametrize("seed", [1, 42])
def test_seed_decides(spark, documents, seed):
    texts = ["some words to cut"] * 30
    assert [r.output for r in fim.rearrange(documents(texts), seed=seed).orderBy("doc_id").collect()] == [
        expected(i, t, seed)[4] for i, t in enumerate(texts)]
