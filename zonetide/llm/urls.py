"""URL filter: rules first, then gradient-boosted trees on lexical features.

URLs that a rule fits are the labelled ones. Trees learned from them judge the others. All of it is
DataFrame operations and Spark's own trees; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import stored

SAMPLE = 10_000  # labelled URLs of each verdict learned from, at most
TREES, DEPTH = 10, 4
ALLOW, BLOCK = "allow", "block"
#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_parameters",
            "f_query", "f_hyphens", "f_suffix_count", "f_suffix_blocked"]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the longest that fits, or null) and its verdict ``_ruled``."""
    kept = pages.drop("host", "path", "rule", "_ruled")
    url = kept["url"].cast("string")
    parts = kept.withColumns({"host": host_of(url), "path": path_of(url)})
    rule = ruled = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host))
                & F.col("path").startswith("/" + path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    null = F.lit(None).cast("string")
    return parts.withColumns({"rule": null if rule is None else rule,
                              "_ruled": null if ruled is None else ruled})


def _entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.split(text, "")
    size = F.greatest(F.length(text), F.lit(1))

    def term(letter: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, letter, F.lit("")))) / size
        return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, c: total + term(c))


def with_features(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns({
        "f_length": F.length(url), "f_host": F.length("host"), "f_path": F.length("path"),
        "f_depth": count(F.col("path"), "/"), "f_labels": count(F.col("host"), "."),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / size, "f_entropy": _entropy(url),
        "f_parameters": count(query, "="), "f_query": F.length(query),
        "f_hyphens": count(url, "-") + count(url, "_"),
        "_suffix": F.substring_index("host", ".", -1)})


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to the pages (which need ``url``). Columns of these
    names are replaced; repeated rows each come back.

    The trees learn from at most ``sample`` different URLs of each verdict, those with the smallest hashes. How often a
    suffix occurs and is blocked is counted over all different URLs that a rule fits, when learning without the URL itself.
    If rules give only one verdict, it is that of all other URLs too; if they give none, all are
    allowed. Null URLs and such without ``://`` have an empty host and path and are judged by the trees.
    """
    ruled = with_rule(pages, rules)
    columns = [c for c in ruled.columns if c != "_ruled"]
    # Under another name each, so that columns of the pages can't clash with features.
    wide = ruled.select(F.struct(*[ruled[c] for c in columns]).alias("_row"), ruled["url"].cast("string"),
                        "host", "path", "_ruled")
    known = wide.where(F.col("_ruled").isNotNull()).select("url", "host", "path", "_ruled").dropDuplicates(["url"])
    known = stored(known, "ruled")
    chosen = None
    for verdict in (ALLOW, BLOCK):
        mine = (known.where(F.col("_ruled") == verdict)
                .orderBy(F.xxhash64("url"), "url").limit(sample))
        chosen = mine if chosen is None else chosen.union(mine)
    blocked = (F.col("_ruled") == BLOCK).cast("double")
    chosen = with_features(chosen).withColumn("label", blocked)
    # Stored, so that its size is known where it is joined; counts combine before the shuffle.
    suffixes = stored(known.groupBy(F.substring_index("host", ".", -1).alias("_suffix")).agg(
        F.count("*").cast("double").alias("_urls"), F.sum(blocked).alias("_blocked")), "suffixes")
    seen = sorted(r["label"] for r in chosen.groupBy("label").count().collect())
    if len(seen) < 2:
        other = F.lit(BLOCK if seen == [1.0] else ALLOW)
        return wide.select("_row.*", F.coalesce("_ruled", other).alias("verdict"))

    def assembled(rows: DataFrame, own: Column, own_blocked: Column) -> DataFrame:
        urls, bad = F.coalesce("_urls", F.lit(0.0)) - own, F.coalesce("_blocked", F.lit(0.0)) - own_blocked
        with_suffix = rows.join(suffixes, "_suffix", "left").withColumns(
            {"f_suffix_count": urls, "f_suffix_blocked": (bad + 1) / (urls + 2)})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix)

    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                          seed=1, checkpointInterval=-1, minInstancesPerNode=5)
    model = trees.fit(assembled(chosen, F.lit(1.0), F.col("label")).select("features", "label"))
    judged = model.transform(assembled(with_features(wide), F.lit(0.0), F.lit(0.0)))
    method = F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)
    return judged.select("_row.*", F.coalesce("_ruled", method).alias("verdict"))
