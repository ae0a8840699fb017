"""Queries over dataset preparation and model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.frames import DAY, micros
from riskweave.operators import datasets, experiment, explain, features, metrics, models, tree_explain
from riskweave.plans import oracle as o
from riskweave.plans.scoring import LOW_LIMIT, refused
from riskweave.plans.registry import query
from riskweave.schemas import FEATURE_NAMES
from riskweave.session import checkpoint_root
from riskweave.sources import driver_tables as d

START = 1_704_067_200_000_000  # 2024-01-01T00:00Z
DAYS = 28

# Activity known at arrival: a band join, then one aggregation per candidate.
KNOWN = f"""known AS (
  SELECT e.transaction_id, count(p.us) AS na,
    count(*) FILTER (WHERE p.us > e.us - {5 * o.MINUTE}) AS n5,
    count(*) FILTER (WHERE p.us > e.us - {10 * o.MINUTE}) AS n10,
    count(*) FILTER (WHERE p.us > e.us - {o.HOUR}) AS n60,
    count(*) FILTER (WHERE p.us > e.us - {o.HOUR} AND p.recipient_id = e.recipient_id) AS nr60,
    min(p.us) FILTER (WHERE p.recipient_id = e.recipient_id) AS first_r,
    max(p.us) AS last_us, count(*) FILTER (WHERE p.device_id = e.device_id) AS ndev
  FROM labeled e LEFT JOIN labeled p ON p.customer_id = e.customer_id AND p.currency = e.currency
    AND p.us < e.us AND p.us > e.us - {180 * o.DAY} AND p.available_us < e.available_us
  GROUP BY 1)"""
ARRIVED = "CASE WHEN p.admitted_us IS NOT NULL THEN greatest(p.admitted_us, p.available_us) END"
LABELED_BASELINE = o.BASELINE.replace(o.ADMITTED, o.LABELED).replace(
    o.held("admitted", "p.admitted_us"), o.held("labeled", ARRIVED)
)
PREPARED = f"""{LABELED_BASELINE}, {KNOWN},
lastd AS (SELECT k.transaction_id, CASE WHEN min(p.device_id) = max(p.device_id)
    THEN min(p.device_id) END AS last_device
  FROM known k JOIN labeled e USING (transaction_id) JOIN labeled p
    ON p.customer_id = e.customer_id AND p.us = k.last_us AND p.available_us < e.available_us
  GROUP BY 1),
f AS (
  SELECT transaction_id, customer_id, currency, us, available_us, label_available_us, label,
    {o.BASELINE_FEATURES}, {o.HOUR_FEATURES}, {o.ACTIVITY_FEATURES}
  FROM b JOIN known USING (transaction_id) LEFT JOIN lastd USING (transaction_id))"""


@query(
    "q_bitemporal_activity",
    f"""WITH {o.LABELED}, {KNOWN} SELECT transaction_id, na AS activity_history_count,
      CAST(n60 AS INTEGER) AS transactions_last_hour, first_r AS first_recipient_us, last_us FROM known""",
)
def bitemporal_activity(spark, sf):
    known = datasets.with_arrived_activity(datasets.replay_frame(d.labeled(spark, sf)))
    return features.candidates(known).selectExpr(
        "transaction_id",
        "n_activity AS activity_history_count",
        "n_60m AS transactions_last_hour",
        "first_recipient_us",
        "last_us",
    )


@query(
    "q_prepare_limited",
    f"""WITH {PREPARED} SELECT {refused(("activity_history_count", "long_history_count",
      "amount_vs_customer_median", "recipient_observed_age_days", "device_changed"),
      "CAST(activity_history_count AS BIGINT)")} FROM f""",
)
def prepare_limited(spark, sf):
    prepared = datasets.prepare(d.labeled(spark, sf), LOW_LIMIT)
    return prepared.select(
        "transaction_id",
        "history_limit_exceeded",
        "activity_history_count",
        "long_history_count",
        "amount_vs_customer_median",
        "recipient_observed_age_days",
        "device_changed",
    )


@query(
    "q_prepare",
    f"""WITH {PREPARED} SELECT *, 'behavior-v1' AS feature_version,
      false AS history_limit_exceeded FROM f""",
)
def prepare(spark, sf):
    return datasets.prepare(d.labeled(spark, sf))


BOUNDS = tuple(START + days * DAY for days in (int(DAYS * 0.6), int(DAYS * 0.8), DAYS + 3))


def _inside(low: int, high: int) -> str:
    return f"us >= {low} AND available_us < {high} AND label_available_us < {high}"


SPLIT = f"""{o.LABELED}, sp AS (
  SELECT *, CASE WHEN held AND {_inside(BOUNDS[1], BOUNDS[2])} THEN 'held_out_test'
      WHEN held THEN NULL
      WHEN available_us < {BOUNDS[0]} AND label_available_us < {BOUNDS[0]} THEN 'train'
      WHEN {_inside(BOUNDS[0], BOUNDS[1])} THEN 'validation'
      WHEN {_inside(BOUNDS[1], BOUNDS[2])} THEN 'test' END AS split
  FROM (SELECT labeled.*, cust.segment = 'MACHINERY' AS held FROM labeled
    JOIN cust USING (customer_id)))"""


def _split(spark, sf):
    held = d.customers(spark, sf).filter("segment = 'MACHINERY'")
    return datasets.split(d.labeled(spark, sf), held, START, DAYS)


@query("q_split", f"WITH {SPLIT} SELECT transaction_id, split FROM sp")
def split(spark, sf):
    return _split(spark, sf).select("transaction_id", "split")


@query(
    "q_split_classes",
    f"""WITH {SPLIT} SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
      count(DISTINCT label) = 2 AS both_classes FROM sp WHERE split IS NOT NULL GROUP BY 1""",
)
def split_classes(spark, sf):
    return datasets.split_classes(_split(spark, sf))


ITEM = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(
    "q_dedup_features",
    f"""SELECT {", ".join(ITEM)}, us, source_row FROM (
      SELECT *, row_number() OVER (PARTITION BY {", ".join(ITEM)} ORDER BY us, source_row) AS rn
      FROM (SELECT *, epoch_us(l_shipdate) AS us, l_orderkey * 100 + l_linenumber AS source_row
        FROM lineitem)) WHERE rn = 1""",
)
def dedup_features(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(
        *ITEM,
        micros(F.col("l_shipdate")).alias("us"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("source_row"),
    )
    return datasets.first_feature_occurrence(rows, ITEM, "us", "source_row")


@query(
    "q_time_split",
    f"""WITH {o.TX}, s AS (SELECT transaction_id, (us - {START}) // 1000000 AS t FROM tx)
    SELECT transaction_id, CASE WHEN t < 86400 THEN 'train' WHEN t < 129600 THEN 'validation'
      ELSE 'test' END AS split FROM s""",
)
def time_split(spark, sf):
    rows = d.transactions(spark, sf).selectExpr(
        "transaction_id", f"(us - {START}) div 1000000 AS t"
    )
    return datasets.time_split(rows, "t").select("transaction_id", "split")


@query(
    "q_class_weights",
    f"""WITH {o.LABELED}, c AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM labeled)
    SELECT n, p AS positives, n::DOUBLE / (2 * p)::DOUBLE AS positive_weight,
      n::DOUBLE / (2 * (n - p))::DOUBLE AS negative_weight,
      (n - p)::DOUBLE / p::DOUBLE AS negatives_per_positive FROM c""",
)
def class_weights(spark, sf):
    return datasets.class_weights(d.labeled(spark, sf))


@query(
    "q_in_scope",
    f"""WITH {o.ADMITTED} SELECT transaction_id, timezone = 'UTC' AND currency = 'KZT' AS in_scope
    FROM admitted""",
)
def in_scope(spark, sf):
    return datasets.in_scope(d.admitted(spark, sf)).select("transaction_id", "in_scope")


TEXT_COLUMNS = ("channel", "currency", "device_id", "status")
DIGEST_COLUMNS = (
    "cents", "channel", "currency", "customer_id", "device_id", "recipient_id", "status",
    "transaction_id", "us",
)
ROW_TEXT = " || ',' || ".join(
    f"""'"{c}":' || """ + (f"""'"' || {c} || '"'""" if c in TEXT_COLUMNS else f"CAST({c} AS VARCHAR)")
    for c in DIGEST_COLUMNS
)
PIECES = ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS piece{i}"
    for i in range(4)
)


@query(
    "q_dataset_digest",
    f"""WITH {o.TX}, hashed AS (SELECT sha256('{{' || {ROW_TEXT} || '}}') AS h FROM tx)
    SELECT count(*) AS n, {PIECES} FROM hashed""",
)
def dataset_digest(spark, sf):
    tx = d.transactions(spark, sf).select(*DIGEST_COLUMNS)
    return datasets.dataset_digest(tx.repartition(7, "recipient_id"))


@query(
    "q_label_independence",
    f"""WITH {o.TX} SELECT transaction_id, true AS label_changed,
      recipient_id = 50 AS amount_changed, false AS activity_changed FROM tx""",
)
def label_independence(spark, sf):
    """Labels turned alone may show nowhere in the vector. In a copy with a few amounts raised these
    show, and nothing of the activity: so the comparison can fail."""
    rows = d.labeled(spark, sf)
    raised = F.col("cents") + F.when(F.col("recipient_id") == 50, 100).otherwise(0)
    # Compared several times; each copy is prepared once.
    checkpoint_root(spark)
    plain, turned, dearer = (
        datasets.prepare(x).checkpoint()
        for x in (rows, rows.withColumn("label", 1 - F.col("label")), rows.withColumn("cents", raised))
    )
    activity = [c for c in FEATURE_NAMES if c in features.ACTIVITY_FEATURES]
    out = plain.select("transaction_id")
    for name, other, columns in (
        ("label", turned, ["label"]),
        ("amount", dearer, ["amount"]),
        ("vector", turned, FEATURE_NAMES),
        ("activity", dearer, activity),
    ):
        left, right = (x.select("transaction_id", *columns) for x in (plain, other))
        found = datasets.changed_rows(left, right).select("transaction_id").distinct()
        out = out.join(found.withColumn(name, F.lit(True)), "transaction_id", "left").na.fill(False, [name])
    return out.select(
        "transaction_id",
        F.col("label").alias("label_changed"),
        F.col("amount").alias("amount_changed"),
        (F.col("vector") | F.col("activity")).alias("activity_changed"),
    )


# --- metrics ------------------------------------------------------------------------------------

SCORES = f"""{o.LABELED}, sc AS (SELECT transaction_id, label, recipient_id / 100.0 AS score
  FROM labeled)"""


def _scores(spark, sf):
    return d.labeled(spark, sf).select(
        "transaction_id", "label", (F.col("recipient_id").cast("double") / 100).alias("score")
    )


@query(
    "q_confusion",
    f"""WITH {SCORES}, c AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
      count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
      count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
      count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
      count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM sc)
    SELECT *, positives::DOUBLE / n AS prevalence, tp::DOUBLE / (tp + fp) AS precision,
      tp::DOUBLE / (tp + fn) AS recall, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1,
      fp::DOUBLE / (fp + tn) AS fpr FROM c""",
)
def confusion(spark, sf):
    return metrics.confusion(_scores(spark, sf), 0.5)


RANKED = f"""{SCORES}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
  FROM g)"""


@query(
    "q_roc_auc",
    f"""WITH {RANKED} SELECT CAST(sum(pos) AS BIGINT) AS positives,
      CAST(sum(neg) AS BIGINT) AS negatives, CAST(sum(neg * (2 * tp - pos)) AS DOUBLE)
        / (sum(pos)::DOUBLE * sum(neg)::DOUBLE * 2) AS roc_auc FROM cu""",
)
def roc_auc(spark, sf):
    return metrics.ranking(_scores(spark, sf)).drop("average_precision")


@query(
    "q_average_precision",
    f"""WITH {RANKED} SELECT round(sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE)
      / sum(pos)::DOUBLE, 10) AS average_precision FROM cu""",
)
def average_precision(spark, sf):
    return metrics.ranking(_scores(spark, sf)).select(
        F.round("average_precision", 10).alias("average_precision")
    )


@query("q_cumulative_scores", f"WITH {RANKED} SELECT score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cu")
def cumulative_scores(spark, sf):
    """The path for very many distinct scores, applied to all."""
    return metrics.cumulative(_scores(spark, sf), slots=10)


GRID = f"""{SCORES}, gr AS (
  SELECT i / 20.0::DOUBLE AS threshold, count(*) FILTER (WHERE label = 1 AND score >= i / 20.0) AS tp,
    count(*) FILTER (WHERE label = 0 AND score >= i / 20.0) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < i / 20.0) AS fn
  FROM sc, range(1, 20) t(i) GROUP BY i),
gf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn)::DOUBLE
  ELSE 0 END AS f1 FROM gr)"""


@query("q_threshold_grid", f"WITH {GRID} SELECT threshold, tp, fp, fn, f1 FROM gf")
def threshold_grid(spark, sf):
    return metrics.threshold_grid(_scores(spark, sf))


@query(
    "q_best_threshold",
    f"WITH {GRID} SELECT threshold, f1 FROM gf ORDER BY f1 DESC, threshold DESC LIMIT 1",
)
def best_threshold(spark, sf):
    return metrics.best_threshold(metrics.threshold_grid(_scores(spark, sf)))


# Three scorings of the same rows stand in for three candidate models.
VARIANTS = {"by_amount": "least(cents / 50000, 1)", "by_hour": "(us % 86400000000) / 86400000000",
            "by_recipient": "recipient_id / 100"}


def _variant_sql(name: str, text: str) -> str:
    text = text.replace("/ ", "/ CAST(").replace("50000", "50000 AS DOUBLE)")
    return text.replace("/ CAST(86400000000", "/ CAST(86400000000 AS DOUBLE)").replace(
        "/ CAST(100", "/ CAST(100 AS DOUBLE)"
    )


def _variants(spark, sf):
    tables = []
    for name, text in VARIANTS.items():
        rows = d.labeled(spark, sf).selectExpr(
            "transaction_id", "label", f"CAST({text} AS DOUBLE) AS score"
        )
        tables.append(metrics.ranking(rows).withColumn("name", F.lit(name)))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


MODELS = f"""{o.LABELED}, vs AS ({" UNION ALL ".join(
    f"SELECT '{n}' AS name, label, {_variant_sql(n, t)} AS score FROM labeled"
    for n, t in VARIANTS.items())}),
vg AS (SELECT name, score, sum(label) AS pos, sum(1 - label) AS neg FROM vs GROUP BY 1, 2),
vc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM vg
  WINDOW w AS (PARTITION BY name ORDER BY score DESC)),
va AS (SELECT name, round(sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE, 10)
  AS average_precision FROM vc GROUP BY 1)"""


@query(
    "q_model_select",
    f"""WITH {MODELS} SELECT name, average_precision FROM va
    ORDER BY average_precision DESC, name LIMIT 1""",
)
def model_select(spark, sf):
    return metrics.select_model(_variants(spark, sf)).select(
        "name", F.round("average_precision", 10).alias("average_precision")
    )


@query(
    "q_seed_summary",
    f"""WITH {MODELS} SELECT count(*) AS runs, round(avg(average_precision), 8) AS mean,
      round(stddev_samp(average_precision), 8) AS sample_sd FROM va""",
)
def seed_summary(spark, sf):
    summary = metrics.seed_summary(_variants(spark, sf), "average_precision")
    return summary.select("runs", F.round("mean", 8).alias("mean"), F.round("sample_sd", 8).alias("sample_sd"))


@query(
    "q_score_parity",
    f"""WITH {SCORES}, other AS (SELECT transaction_id,
        score + CASE WHEN label = 1 THEN 1e-8 ELSE 0 END AS other FROM sc WHERE score <> 0.33),
      met AS (SELECT * FROM sc FULL JOIN other USING (transaction_id))
    SELECT count(*) AS n, count(*) FILTER (WHERE other IS NULL OR score IS NULL) AS unmatched,
      max(abs(score - other)) AS max_abs_difference,
      count(*) = count(other) AND max(abs(score - other)) <= 1e-7 AS within FROM met""",
)
def score_parity(spark, sf):
    """Tiny differences, and rows that only one side has."""
    scores = _scores(spark, sf)
    other = scores.filter("score <> 0.33").withColumn(
        "score", F.col("score") + F.when(F.col("label") == 1, 1e-8).otherwise(0.0)
    )
    return metrics.score_parity(scores, other)


SCORED = f"""WITH {SPLIT} SELECT transaction_id, split, label, true AS score_in_range FROM sp
  WHERE split IS NOT NULL AND split <> 'train'"""


def _prepared_split(spark, sf):
    held = d.customers(spark, sf).filter("segment = 'MACHINERY'")
    rows = datasets.split(datasets.prepare(d.labeled(spark, sf), whole=True), held, START, DAYS)
    return rows.filter("split IS NOT NULL")


def _fitted(spark, sf, name):
    """A model of the training split, and the other rows."""
    # Fitting makes several passes; the prepared rows are computed once for all of them.
    checkpoint_root(spark)
    rows = _prepared_split(spark, sf).checkpoint()
    fitted = models.fit_candidates(rows.filter("split = 'train'"), seed=17, names=(name,))[name]
    return fitted, rows.filter("split <> 'train'")


def _model_scores(spark, sf, name):
    """Fitted on the training split, applied to the other rows."""
    scored = models.score(*_fitted(spark, sf, name))
    return scored.select(
        "transaction_id", "split", "label", F.col("score").between(0, 1).alias("score_in_range")
    )


@query("q_logistic_scores", SCORED)
def logistic_scores(spark, sf):
    return _model_scores(spark, sf, "logistic_regression")


@query("q_random_forest_scores", SCORED)
def random_forest_scores(spark, sf):
    return _model_scores(spark, sf, "random_forest")


@query("q_boosted_tree_scores", SCORED)
def boosted_tree_scores(spark, sf):
    return _model_scores(spark, sf, "boosted_trees")


@query(
    "q_experiment",
    f"""WITH {SPLIT} SELECT split, count(*) AS n, sum(label) AS positives, true AS best_chosen,
      true AS on_grid, true AS counts_add_up, true AS rates_in_range
    FROM sp WHERE split IN ('test', 'held_out_test') GROUP BY split""",
)
def whole_experiment(spark, sf):
    """Three candidates of 120 trees, the choice, the threshold, and the test metrics."""
    found = experiment.experiment(_prepared_split(spark, sf))
    quality = {r["name"]: r["average_precision"] for r in found.candidates.collect()}
    rates = [F.col(c) for c in ("precision", "recall", "f1", "fpr", "roc_auc", "average_precision")]
    return found.tests.select(
        "split",
        "n",
        "positives",
        F.lit(quality[found.chosen] == max(quality.values())).alias("best_chosen"),
        F.lit(found.threshold in [i / 20 for i in range(1, 20)]).alias("on_grid"),
        ((F.expr("tn + fp + fn + tp") == F.col("n")) & (F.expr("tp + fn") == F.col("positives"))).alias(
            "counts_add_up"
        ),
        F.forall(F.array(*rates), lambda r: F.coalesce(r.between(0, 1), F.lit(True))).alias("rates_in_range"),
    )


@query(
    "q_tree_explanations",
    f"""WITH {SPLIT} SELECT transaction_id, true AS consistent, concat_ws(',',
      CASE WHEN transaction_id % 13 = 0 THEN 'not_evaluated' END,
      CASE WHEN transaction_id % 13 <> 0 AND transaction_id % 11 = 0 THEN 'vector' END,
      CASE WHEN transaction_id % 13 <> 0 AND transaction_id % 7 = 0 THEN 'model_version' END,
      CASE WHEN transaction_id % 13 <> 0 AND transaction_id % 5 = 0 THEN 'score' END) AS violations
    FROM sp WHERE split IS NOT NULL AND split <> 'train'""",
)
def tree_explanations(spark, sf):
    """Boosted trees explained, and compared with stored evaluations of which some differ."""
    fitted, rows = _fitted(spark, sf, "boosted_trees")
    explained = tree_explain.tree_contributions(rows, fitted.stages[-1], FEATURE_NAMES)
    explained = explain.with_consistency(explained).withColumn("model_version", F.lit("trees-1"))
    row = F.col("transaction_id")
    vector = F.array(*(F.col(n).cast("double") for n in FEATURE_NAMES))
    evaluated = models.score(fitted, rows).select(
        row,
        F.when(row % 11 == 0, F.transform(vector, lambda x: x + 1)).otherwise(vector).alias("vector"),
        (F.col("score") + F.when(row % 5 == 0, 0.1).otherwise(0.0)).alias("score"),
        F.when(row % 7 == 0, "trees-0").otherwise("trees-1").alias("model_version"),
    )
    compared = explain.evaluation_differences(explained, evaluated.filter("transaction_id % 13 <> 0"))
    return compared.select("transaction_id", "consistent", F.array_join("violations", ",").alias("violations"))
