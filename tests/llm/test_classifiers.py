"""Toxicity, quality and URL verdicts: held-out accuracy, and rows that hold little."""

import random

import pytest

from zonetide.llm import bpe, quality, toxicity, urls


def texts(kind, count, seed):
    random.seed(seed)
    parts = ["re", "an", "th", "on", "er", "ing", "ti", "es", "ou", "ha"]
    out = []
    for _ in range(count):
        words = ["".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(random.randint(30, 120))]
        if kind == "toxic":
            for _ in range(4):
                words.insert(random.randrange(len(words)), random.choice(["scumbag", "vileness", "moronic"]))
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        out.append(" ".join(words) + ".")
    return out


@pytest.mark.parametrize("operator, bad", [(toxicity, "toxic"), (quality, "junk")])
def test_held_out_texts_are_told_apart(spark, documents, operator, bad):
    good_is = 0 if operator is toxicity else 1
    rows = [(t, good_is) for t in texts("good", 120, 1)] + [(t, 1 - good_is) for t in texts(bad, 60, 2)]
    random.Random(5).shuffle(rows)
    docs = documents([t for t, _ in rows])
    label = "toxic" if operator is toxicity else "quality"
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], f"doc_id long, {label} int")
    model = operator.train(docs, labels.unionByName(labels))
    fresh = documents(texts("good", 40, 3) + texts(bad, 40, 4))
    scores = {r.doc_id: r.score for r in operator.score(fresh, model).collect()}
    cut = 0.5 if operator is toxicity else quality.CUT
    right = sum((s >= cut) == ((i < 40) == bool(good_is)) for i, s in scores.items())
    assert right >= 76
    assert all(0 <= s <= 1 for s in scores.values())


def test_awkward_rows_and_missing_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for operator, expected in ((toxicity, 0.0), (quality, 1.0)):
        model = operator.train(awkward, none)
        rows = operator.score(awkward, model).collect()
        assert len(rows) == 9 and all(abs(r.score - expected) < 1e-6 for r in rows)
        assert operator.score(awkward.limit(0), model).collect() == []
    kept = toxicity.filter_toxic(awkward, toxicity.train(awkward, none))
    assert kept.columns == awkward.columns and kept.count() == 9


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for v, r in urls.RULES for h, _, p in [r.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_urls_follow_rules_and_then_trees(spark):
    given = [f"http://{h}.example.{t}/{p}/{i}?q={i}" for i in range(12) for h in ("a", "B")
             for t in ("net", "com", "org") for p in ("en", "de", "fr")]
    given += [None, "", "no scheme", "https://", "http://net", "http://net/", "http://X.NET?a/b", "http://notnet/",
              "ftp://a.net:80/#x", "x://example.net/en/y#z", "http://é.org/fr/ü", "http://a://b/", given[0]]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").selectExpr(
        "*", "'mine' AS f_length", "1 AS features", "'x' AS rule", "'y' AS _suffix")
    verdicts = dict((r, v) for v, r in urls.RULES)
    rows = urls.judge(pages).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert (r.host, r.path, r.rule) == plain_rule(r.url)
        assert r.verdict in ("allow", "block") and r.verdict == verdicts.get(r.rule, r.verdict)
        assert r.f_length == "mine"
    assert urls.judge(pages.limit(0)).collect() == []
    one = urls.judge(pages.where("url LIKE '%.com/%' OR url IS NULL")).collect()
    assert {r.verdict for r in one} == {"block"}
    plan = urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_with_the_names_of_helpers_are_kept(spark, awkward):
    docs = awkward.selectExpr("*", "'w' AS _whole", "'t' AS _text", "'i' AS _ids")
    vocabulary = bpe.default_vocabulary()
    results = [toxicity.score(docs, toxicity.fit([])), quality.score(docs, quality.fit([]))]
    encoded = bpe.encode(docs, vocabulary, bpe.frequent_lexicon(docs, vocabulary))
    for found in [*results, encoded, bpe.decode(encoded, vocabulary)]:
        assert {(r._whole, r._text, r._ids) for r in found.collect()} == {("w", "t", "i")}


def test_suffix_statistics_count_all_ruled_urls_once(spark, monkeypatch):
    seen = {}
    plain = urls.stored

    def kept(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(urls, "stored", kept)
    pages = [(i, f"http://a{i}.net/x") for i in range(30)] + [(i, "http://b.fr.org/fr/1") for i in range(40)]
    pages += [(i, f"http://c{i}.org/fr/{i}") for i in range(20)] + [(99, "http://other.xyz/1"), (100, None)]
    judged = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), sample=5)
    assert judged.count() == 92
    assert {r._suffix: (r._urls, r._blocked) for r in seen["suffixes"].collect()} == {"net": (30.0, 30.0), "org": (21.0, 0.0)}
