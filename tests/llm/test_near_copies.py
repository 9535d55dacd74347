"""Near copies in the pipeline against a comparison of all pairs."""

import random

import numpy as np

import corpus_pipeline
from zonetide.llm import common, near_copies


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_kept(texts):
    """Smallest id of each component of texts with a similarity of 0.8 or more."""
    sets = [plain_shingles(t or "") for t in texts]
    name = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if name[i] != name[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    return {i for i, n in enumerate(name) if i == n}


def test_one_of_each_as_by_brute_force(spark, documents):
    random.seed(3)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 400))
    texts = []
    for _ in range(12):
        text = [word() for _ in range(random.choice((4, 30, 120, 300)))]
        texts.append(" ".join(text))
        for _ in range(8):  # copies of copies, so that groups are chains
            text = list(text)
            for _ in range(random.randint(0, max(1, len(text) // 40))):
                text[random.randrange(len(text))] = word()
            texts.append(" ".join(text).upper() if random.random() < 0.3 else "\n".join(text))
    texts += ["", None, "  ", "one two", "ONE\ttwo", "one two three four five"]
    random.shuffle(texts)
    kept = corpus_pipeline.keep_one_of_each(spark, documents(texts), "")
    assert {r.doc_id for r in kept.collect()} == plain_kept(texts)
    assert corpus_pipeline.keep_one_of_each(spark, documents(["x"]).limit(0), "").collect() == []


def test_a_copy_with_every_twelfth_part_changed_goes(spark, documents):
    text = [f"word{i}" for i in range(400)]
    copy = list(text)
    for at in range(20, 400, 60):  # 5 of 396 shingles each
        copy[at] = "other"
    docs = documents([" ".join(text), " ".join(copy)])
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [0]


def varied(text, changes, word):
    copy = list(text)
    for _ in range(changes):
        copy[random.randrange(len(copy))] = word()
    return copy


def test_sets_that_join_groups():
    random.seed(5)
    pool = np.random.default_rng(1).integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(60):
        sets = [np.sort(np.random.default_rng(random.randrange(1000)).choice(
            pool, random.randint(1, 20), replace=False)) for _ in range(random.randint(1, 6))]
        sets += [np.unique(np.concatenate((s[1:], pool[:1]))) for s in sets if len(s) > 2]
        group = [random.randint(0, 4) for _ in sets]
        asked = sorted(random.sample(range(len(sets)), random.randint(1, len(sets))))
        links = near_copies.joining(sets, [sets[i] for i in asked], np.array(group), np.array([group[i] for i in asked]))

        def partition(pairs):
            name = list(group)
            for a, b in pairs:
                name = [name[b] if n == name[a] else n for n in name]
            return [[n == m for m in name] for n in name]

        def near(a, b):
            same = len(np.intersect1d(sets[a], sets[b]))
            return same >= 0.8 * (len(sets[a]) + len(sets[b]) - same)

        found = [(asked[a], b) for a, b in links]
        assert all(near(a, b) for a, b in found)
        assert partition(found) == partition([(a, b) for a in asked for b in range(len(sets)) if near(a, b)])


def large_group(members):
    """Copies of one text, each changed on its own, so that many are less than 0.8 alike; and their plain result."""
    random.seed(9)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 4000))
    base = [word() for _ in range(150)]
    return [" ".join(varied(base, random.randint(0, 6), word)) for _ in range(members)]


def test_rows_stay_in_proportion_to_a_large_group(spark, documents, monkeypatch):
    texts = large_group(500)
    rows = {}

    def counted(df, name):
        found = common.stored(df, name)
        rows[name] = rows.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(near_copies, "stored", counted)
    groups = near_copies.grouped(documents(texts)).collect()
    first = {}
    for r in groups:
        first[r._component] = min(first.get(r._component, r.doc_id), r.doc_id)
    assert set(first.values()) == plain_kept(texts)
    assert rows["pairs"] + rows["met"] < 4 * 500 * near_copies.KEYS


def test_split_keys_lose_nothing(spark, documents, monkeypatch):
    texts = large_group(120)
    monkeypatch.setattr(near_copies, "PART", 1500)
    monkeypatch.setattr(near_copies, "ASKED_AT_ONCE", 7)
    kept = corpus_pipeline.keep_one_of_each(spark, documents(texts), "")
    assert {r.doc_id for r in kept.collect()} == plain_kept(texts)


def test_very_long_texts_and_awkward_rows(spark, documents, awkward):
    long = [f"w{i % 50_021}x{i % 7}" for i in range(400_000)]
    docs = documents([" ".join(long), " ".join([*long[:-50], "end"]), "short"])
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == {0, 2}
    assert corpus_pipeline.keep_one_of_each(spark, awkward, "").columns == awkward.columns
