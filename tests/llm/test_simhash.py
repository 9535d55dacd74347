"""SimHash near-dedup against a brute-force version."""

import random
import re

import numpy as np
import xxhash

from zonetide.llm import simhash


def plain_fingerprint(text):
    lower = text.translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(prints):
    """{id: smallest id reachable} of {id: fingerprint}."""
    name = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and name[b] < name[a]:
                    name[a], changed = name[b], True
    return name


def test_one_differing_bit_always_meets():
    random_ = np.random.default_rng(0)
    segment = random_.integers(0, 1 << 22, 5000)
    other = segment ^ (1 << random_.integers(0, 22, 5000))
    asked, stored = simhash.codewords(segment), simhash.codewords(other)[:, 0]
    assert (asked == stored[:, None]).any(axis=1).all()


def test_links_are_found_as_by_brute_force(spark):
    random.seed(1)
    centres = [random.getrandbits(64) for _ in range(40)]
    prints = {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4)))
              for c in centres for _ in range(8)}
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "fp long")).collect()}
    from zonetide.llm.components import components as spark_components
    links = spark.createDataFrame(list(found), "a long, b long")
    got = {r.node: r.component for r in spark_components(links).collect()}
    expected = components({p: p & (1 << 64) - 1 for (p,) in rows})
    assert {p: got.get(p, p) for (p,) in rows} == expected


def test_documents_and_crowded_keys(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "STORED_AT_ONCE", 2)  # so that keys are split
    text = " ".join(f"word{i}" for i in range(300))
    texts = [text, text.upper(), text.replace("word7 ", "other "), "quite another text than the others", "", "  ",
             None, "one", "one two"]
    docs = documents(texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == prints
    assert {i: r.component_id for i, r in rows.items()} == components(prints)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {i for i, name in components(prints).items() if i == name}


def test_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.doc_id is None} == {1, 2}
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 5]
    assert simhash.one_of_each(awkward.limit(0)).collect() == []
