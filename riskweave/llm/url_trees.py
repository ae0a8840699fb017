"""URL verdicts: listed rules first, else gradient-boosted trees on lexical features.

The trees learn from the URLs that the rules label. DataFrame functions and Spark's own tree
learner only.
"""

from __future__ import annotations

import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import free_name, freeze

#: At most about this many labelled addresses are used to fit the trees.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
FEATURES = (
    "length",
    "host_length",
    "host_labels",
    "depth",
    "longest_segment",
    "digit_ratio",
    "host_digits",
    "hyphens",
    "entropy",
    "parameters",
    "fragment",
    "secure",
    "suffix_log_count",
    "suffix_length",
    "suffix_depth",
    "suffix_digit_ratio",
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each ``host`` and ``path`` (on a tie that of the longer host).

    Rules are rows ``rule`` (host, then path from its first slash) and ``verdict``. Each address
    meets the rules of its host and of every domain above by an equi-join.
    """
    at = F.instr("rule", "/")
    listed = rules.select(
        "rule",
        F.col("verdict").alias("listed"),
        F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule")).alias("domain"),
        F.when(at > 0, F.substring("rule", at, F.length("rule"))).otherwise("").alias("prefix"),
    )
    labels = F.split("host", "\\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = (
        addresses.select("host", "path", F.explode(above).alias("domain"))
        .join(listed, "domain")
        .where(F.startswith("path", "prefix"))
    )
    rank = F.struct(F.length("rule").alias("n"), F.length("domain").alias("d"), F.col("rule"), F.col("listed"))
    best = fitting.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.listed").alias("listed"))


def lexical(pages: DataFrame) -> DataFrame:
    """Features of ``url``, with its ``host`` and ``path`` at hand, and its ``suffix``."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]+", ""))
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))
    )
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    return pages.select(
        "*",
        F.element_at(F.split("host", "\\."), -1).alias("suffix"),
        n.cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.split("host", "\\.")).cast("double").alias("host_labels"),
        F.size(segments).cast("double").alias("depth"),
        F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)).cast("double").alias("longest_segment"),
        F.when(n > 0, digits / n).otherwise(0.0).alias("digit_ratio"),
        F.length(F.regexp_replace("host", "[^0-9]+", "")).cast("double").alias("host_digits"),
        F.length(F.regexp_replace(url, "[^-]+", "")).cast("double").alias("hyphens"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double").alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.startswith(F.lower(url), F.lit("https:")).cast("double").alias("secure"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``score`` (blocking chance, null if ruled) and ``verdict``.

    A listed rule decides; else the trees, fitted on at most about ``train_rows`` addresses that
    rules label, chosen by hash. Where rules label no address, or all alike, that one verdict (or
    ``default``) stands for the trees. A null ``url`` or one without ``://`` has empty host and path
    and goes to the trees. Repeated rows are judged alike. An empty table gives an empty table.
    Columns of the input that clash with an added one or a feature get underscores before them.
    """
    own = ("host", "path", "rule", "listed", "suffix", "score", "verdict", *FEATURES)
    for name in pages.columns:
        if name.lower() in own:
            pages = pages.withColumnRenamed(name, free_name(f"_{name}", [*pages.columns, *own]))
    placed = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    addresses = placed.select("host", "path").distinct()
    known = placed.join(ruled(addresses, rules), ["host", "path"], "left")
    blocked = (F.col("listed") == "block").cast("double")
    rows = lexical(known.select("url", "host", "path", blocked.alias("label")))
    statistics = rows.groupBy("suffix").agg(
        F.log2(F.count("*") + 1).alias("suffix_log_count"),
        F.avg("length").alias("suffix_length"),
        F.avg("depth").alias("suffix_depth"),
        F.avg("digit_ratio").alias("suffix_digit_ratio"),
    )
    statistics = freeze(statistics)
    n, k = rows.agg(F.count("label"), F.sum("label")).first()
    if n and 0 < k < n:
        place = F.pmod(F.xxhash64("host", "path"), F.lit(1_000_000))
        labelled = rows.where(F.col("label").isNotNull() & (place < 1_000_000 * min(1.0, train_rows / n)))
        train = freeze(labelled.join(statistics, "suffix").select("label", *FEATURES))
        trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(train)
        ready = lexical(known).join(statistics, "suffix", "left")
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    else:
        only = float(k / n) if n else float(default == "block")
        scored = known.withColumn("score", F.lit(only))
    guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        *pages.columns,
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
        F.coalesce("listed", guess).alias("verdict"),
    )
