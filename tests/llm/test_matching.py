"""Embeddings, license scan and decontamination."""

import random

import numpy as np

from zonetide.llm import decontaminate, embeddings, licenses
from zonetide.llm.hnsw import Graph


def plain_links(rows):
    """{row: (links, component)} by comparing all pairs."""
    unit = {}
    for k, (_, vector, label) in enumerate(rows):
        if label is None or not vector or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        v = np.array(vector, float)
        v = v / np.abs(v).max()
        unit[k] = v / np.linalg.norm(v)
    near = {k: [j for j in unit if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k])
                and unit[j] @ unit[k] >= 0.93] if k in unit else [] for k in range(len(rows))}
    name = {k: rows[k][0] for k in near}
    for _ in rows:
        for k, others in near.items():
            name[k] = min([name[k], *(name[j] for j in others)])
    return sorted((rows[k][0], len(near[k]), name[k], rows[k][0] == name[k]) for k in near)


def test_embeddings_as_by_brute_force(spark):
    random_ = np.random.default_rng(2)
    centres = random_.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + random_.normal(size=16) * 0.12).tolist(), int(i % 30 % 3)) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)] + [
        (400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] + [1.0] * 15, 1),
        (404, [float("inf")] * 16, 1), (405, [None] + [1.0] * 15, 1), (406, rows[1][1], None),
        (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [1e300, 2e300], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "7 AS node", "8 AS first")
    for size in (1000, 20):
        found = sorted(tuple(r) for r in embeddings.near_duplicates(vectors, shard_size=size).collect())
        assert found == plain_links(rows)
    assert embeddings.near_duplicates(vectors.limit(0)).collect() == []


def test_licenses_are_found_with_their_differences(documents):
    docs = documents(["Some text.\nReleased under the MIT License.\nMore text.", "Licensed under CC BY-SA 4.0.",
                      "This work is licenced under the GNU General Public License, version 3. And on it goes.",
                      "é " * 5000 + "Licensed under the Apache License, Version 2.0.", "I have a driving license.",
                      None, "", "Licensed under the Apache License, Version 2.0.\n" * 2, (None, "All rights reserved.")])
    rows = sorted(licenses.scan(docs.withColumnRenamed("lang", "license")).collect(), key=lambda r: (r.doc_id or -1, r.start))
    assert [(r.doc_id, r.license) for r in rows] == [
        (None, "all-rights-reserved"), (0, "MIT"), (1, "CC-BY-SA-4.0"), (2, "GPL-3.0"), (3, "Apache-2.0"),
        (7, "Apache-2.0"), (7, "Apache-2.0")]
    assert rows[1].matched == 1.0 and rows[1].missing == "" and rows[1].start == 11
    assert rows[3].missing == "licensed" and rows[4].start == len(("é " * 5000).encode())
    assert licenses.scan(docs.limit(0)).collect() == []


def plain_score(item, text):
    """Smith-Waterman over words, cell by cell."""
    best, last = 0, [0] * (len(text) + 1)
    for a in item:
        now = [0]
        for j, b in enumerate(text, 1):
            now.append(max(0, last[j - 1] + (2 if a == b else -1), last[j] - 1, now[j - 1] - 1))
        best, last = max(best, *now), now
    return best / (2 * len(item))


def test_copies_are_found_and_scored_as_by_brute_force(spark, documents):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 6)))
    items = [[word() for _ in range(n)] for n in (30, 45, 20, 8)] + [["just", "four", "plain", "words"]]
    texts, expected = [], {}
    for i in range(60):
        before, after = ([word() for _ in range(random.randint(0, 80))] for _ in range(2))
        copy = []
        if i % 3:
            copy = list(items[i % 5])
            for _ in range(i % 4 if len(copy) > 20 else 0):
                at = random.randrange(len(copy))
                copy[at:at + 1] = random.choice([[], [word()], [copy[at], word()]])
        text = before + copy + after
        texts.append(" ".join(text).upper() if i % 2 else ", ".join(text))
        for n, item in enumerate(items):
            score = plain_score(item, text)
            if score >= (0.6 if len(item) >= 8 else 1.0):
                expected[i, n] = score
    docs = documents([*texts, None, "", (None, " ".join(items[0])), (0, texts[0])])
    benchmark = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (9, None), (10, "?"),
                                       (None, texts[1]), (0, " ".join(items[0]))], "item_id long, text string")
    rows = decontaminate.contaminated(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id): r.score for r in rows}
    assert found.pop((None, 0)) == 1.0
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(62)) - {k[0] for k in expected}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), benchmark).collect() == []


def invented(spread):
    return "".join(random.choices("abcdefghij", k=random.randint(2, spread)))


def found_pairs(spark, docs, items):
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, benchmark).collect()}


def test_words_put_in_after_every_second_word_hide_nothing(spark, documents):
    random.seed(8)
    items = [[invented(7) for _ in range(random.randint(12, 60))] for _ in range(40)]
    texts = []
    for item in items:
        copy = []
        for at, word in enumerate(item):
            copy += [word] if at % 2 == 0 else [word, invented(7)]
        texts.append([invented(7) for _ in range(50)] + copy + [invented(7) for _ in range(50)])
    found = found_pairs(spark, documents([" ".join(t) for t in texts]), items)
    assert {k for k in found if k[0] == k[1]} == {(i, i) for i in range(40)}
    for i, item in enumerate(items):
        assert abs(found[i, i].score - plain_score(item, texts[i])) < 1e-9


def test_seeds_stay_however_large_the_corpus(spark, documents, monkeypatch):
    random.seed(9)
    items = [[invented(4) for _ in range(random.randint(20, 50))] for _ in range(100)]
    texts = []
    for item in items:
        copy = [invented(4) if random.random() < 0.2 else w for w in item]
        texts.append([invented(4) for _ in range(80)] + copy)
    plain = decontaminate._chances
    # All words as frequent as in a corpus 10^8 times as large.
    monkeypatch.setattr(decontaminate, "_chances", lambda c, v: (plain(c, v)[0], plain(c, v)[1] * 10 ** 8))
    found = found_pairs(spark, documents([" ".join(t) for t in texts]), items)
    wanted = {i for i, item in enumerate(items) if plain_score(item, texts[i]) >= 0.6}
    assert len(wanted) > 20 and len({i for i in wanted if (i, i) in found}) >= 0.98 * len(wanted)


def test_long_items_are_judged_whole(spark, documents):
    random.seed(10)
    item = [invented(8) for _ in range(5005)]
    edited = [w for at, w in enumerate(item) if at % 20]
    docs = documents([" ".join(item), " ".join(item[:2000]), " ".join(item[:3400]), " ".join(edited),
                      " ".join(["x"] * 300 + item[:2500] + ["y"] * 9 + item[2500:] + ["z"] * 20)])
    found = {k[0]: r for k, r in found_pairs(spark, docs, [item]).items()}
    assert found.keys() == {0, 2, 3, 4}
    assert found[0].score == 1.0 and found[0].matched == 5005 and (found[0].first_word, found[0].last_word) == (0, 5004)
    assert abs(found[2].score - 3400 / 5005) < 1e-9
    assert abs(found[3].score - (2 * 4754 - 251) / 10010) < 0.01
    assert abs(found[4].score - (10010 - 9) / 10010) < 1e-9 and found[4].first_word == 300


def test_an_audit_counts_links_to_others_only():
    random_ = np.random.default_rng(4)
    vectors = random_.normal(size=(600, 24))
    vectors[300:] = vectors[:300] + random_.normal(size=(300, 24)) * 0.05  # one link each
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = Graph(vectors.astype(np.float32))
    rows = np.arange(600)
    assert embeddings.links_found(graph, graph.vectors, rows, 0.93, 600) == (600, 600)
    assert embeddings.links_found(graph, graph.vectors[:10], np.full(10, -1), 0.93, 600) == (20, 20)
    assert embeddings.audited_beam(graph, rows, 0.93) >= 64
