"""Quality rules of documents, and verdicts on their hosts from shrunk failure rates.

A host's failure rate is drawn towards all hosts' rate by a beta prior, whose strength comes from
how far the rates of hosts differ beyond what chance gives. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import BLANKS, free_name, once, spread_join, stored, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A host is turned away if its shrunk rate of failed documents is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_LEAST, PRIOR_MOST = 10.0, 1e6
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeat_words(w: Column, hashes: Column) -> Column:
    """Words in windows of eight words that are found twice or more in the text.

    Texts whose windows all have different hashes have none; only the others compare the windows
    themselves, which are sorted, so that equal ones stand side by side.
    """
    sorted_windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.size(hashes)),
            lambda i: F.struct(F.array_join(F.slice(w, i, F.lit(WINDOW)), " ").alias("g"), i.alias("at")),
        )
    )

    def starts(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))

        found = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.array_sort(F.transform(found, lambda x: x["at"]))

    at = F.transform(F.array(sorted_windows), starts)[0]
    until, total = F.lit(0).alias("until"), F.lit(0).alias("total")
    count = F.aggregate(
        at,
        F.struct(until, total),
        lambda a, p: F.struct(
            (p + WINDOW).alias("until"),
            (a["total"] + F.least(F.lit(WINDOW), p + WINDOW - a["until"])).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), count).otherwise(0)


def base_rules(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The documents with the rule columns, and the names these have (underscores if taken)."""
    names = {n: free_name(n, docs.columns) for n in RULES}
    w, h = free_name("w", docs.columns), free_name("h", docs.columns)
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    split = docs.select("*", once(w, words(whole)))
    hashes = F.when(
        F.size(w) > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select("*", once(h, hashes))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    chars = F.aggregate(F.col(w), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    judged = hashed.select(
        *[hashed[c] for c in docs.columns],
        F.size(w).cast("long").alias(names["n_words"]),
        chars.alias(names["word_chars"]),
        F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long").alias(names["n_symbols"]),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
        .cast("long")
        .alias(names["n_dup_lines"]),
        _repeat_words(F.col(w), F.col(h)).cast("long").alias(names["n_repeat_words"]),
    )
    n, repeated = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    return judged.withColumn(names["base_failed"], failed), names


def host_verdicts(judged: DataFrame, host: str, failed: str, limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each host (null is one): documents, failures, shrunk rate, and whether it passes."""
    rows = judged.groupBy(host).agg(
        F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed")
    )
    all_hosts = rows.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failed").alias("f"),
        F.count("*").alias("hosts"),
        F.sum(F.col("host_failed") ** 2 / F.col("host_docs")).alias("ff"),
    ).first()
    total = all_hosts["n"] or 0
    mean = all_hosts["f"] / total if total else 0.0
    noise = mean * (1 - mean)
    spread = (all_hosts["ff"] / total - mean**2 - noise * all_hosts["hosts"] / total) if total else 0.0
    strength = min(PRIOR_MOST, max(PRIOR_LEAST, noise / spread - 1)) if spread > 0 else PRIOR_MOST
    rate = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return rows.withColumn("host_rate", rate).withColumn("host_passes", rate <= limit)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    carry_text: bool = True,
    limit: float = HOST_LIMIT,
) -> DataFrame:
    """Documents with the base rules, their host's shrunk rate, and ``kept``.

    ``kept`` is false where the base rules fail (fewer than 20 words, or over 30 % of the words in
    repeated windows) or where the host's verdict turns all of it away. A null text has no words
    and fails. A null host is a host. Repeated rows count each. Columns that are added get
    underscores before a name that is taken. An empty table gives an empty table.
    """
    judged, names = base_rules(docs, text)
    held = stored(judged if carry_text else judged.drop(text), "judged")
    verdicts = host_verdicts(held, host, names["base_failed"], limit)
    added = {c: free_name(c, held.columns) for c in ("host_docs", "host_failed", "host_rate", "host_passes", "kept")}
    verdicts = verdicts.withColumnsRenamed({k: v for k, v in added.items() if k != "kept"})
    joined = spread_join(held, verdicts, host)
    return joined.withColumn(added["kept"], ~F.col(names["base_failed"]) & F.col(added["host_passes"]))
