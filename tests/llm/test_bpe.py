"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from zonetide.llm import bpe
from zonetide.llm.lexicon import Lexicon, compile_lexicon

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_lexicon_finds_its_words_only():
    words = {w.encode(): [i, i + 1][:1 + i % 2] for i, w in enumerate(
        ["a", "an", "and", "band", "land", "lands", "é", "ét", " the", " then"])}
    lexicon = Lexicon(compile_lexicon(words))
    asked = [*words, b"", b"b", b"lan", b"bands", b"zz", "è".encode()]
    ends = np.cumsum([len(w) for w in asked])
    numbers = lexicon.numbers(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], ends)
    assert [list(lexicon.output(n)) if n >= 0 else None for n in numbers] == [words.get(w) for w in asked]
    assert Lexicon(compile_lexicon({})).numbers(np.zeros(1, np.uint8), np.array([0]), np.array([1])) == [-1]


def test_ids_are_the_librarys(library):
    random.seed(4)
    parts = ["a", "The", " then", "'s", "'S", "'ll", "'", "''", " ", "  ", "\n", "\t", "\u00a0", "é", "日本", "²",
             "Ⅷ", "🙂", "\u0301", "_", "!!", "123", "<|endoftext|>", "<|endof", "\x1c", "\x85", "don't", "aaaaaaa"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(800)]
    encoder = bpe.Encoder(PATH, compile_lexicon({b" then": library.encode(" then").ids}))
    ids, offsets = encoder.encode(pa.array(texts))
    for text, low, high in zip(texts, offsets[:-1], offsets[1:], strict=True):
        mine = ids[low:high]
        assert mine.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.tokens.decode(mine.astype(np.int64)).decode() == text


def test_rows_through_spark(spark, awkward, library):
    docs = awkward.withColumnRenamed("_row", "n_tokens")
    lexicon = bpe.frequent_lexicon(docs, PATH, 4)
    rows = bpe.encode(docs, PATH, lexicon, decoded=True).collect()
    assert len(rows) == 9
    for r in rows:
        text = r.text or ""
        expected = library.encode(text, add_special_tokens=False).ids
        assert (r.token_ids, r.n_tokens) == (expected, len(expected))
        assert r.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert bytes(r.decoded).decode() == text
    ids = spark.createDataFrame([(1, [464, 3290]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert [r.text for r in bpe.decode(ids, PATH).orderBy("doc_id").collect()] == ["The dog", "", ""]
    assert bpe.encode(docs.limit(0), PATH, bpe.frequent_lexicon(docs.limit(0), PATH)).collect() == []
