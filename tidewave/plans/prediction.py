"""Queries of validators, metrics and stored models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import models, validation
from tidewave.plans.registry import query
from tidewave.sources import tables

_ROWS = "f AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS class FROM embeddings)"
_PLACE = "('0x' || substr(md5('{seed}-' || row_id), 1, 13))::BIGINT"


def _folds(order: str, k: int, source: str = "f") -> str:
    return f"SELECT row_id, (CASE WHEN rn < (n // {k} + 1) * (n % {k}) THEN rn // (n // {k} + 1) ELSE (rn - n % {k}) // (n // {k}) END)::BIGINT AS fold FROM (SELECT row_id, row_number() OVER (ORDER BY {order}) - 1 AS rn, count(*) OVER () AS n FROM {source})"


@query("cv_kfold", f"WITH {_ROWS} {_folds('row_id', 7)}")
def cv_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return validation.k_fold(tables.features(spark, sf), 7)


@query("cv_kfold_shuffled", f"WITH {_ROWS} {_folds(_PLACE.format(seed=5) + ', row_id', 7)}")
def cv_kfold_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return validation.k_fold(tables.features(spark, sf), 7, 5)


@query("cv_repeated", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT row_id, {r} AS repeat, fold FROM ({_folds(_PLACE.format(seed=r) + ', row_id', 5)})" for r in range(3)))
def cv_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return validation.repeated_k_fold(tables.features(spark, sf), 5, 3)


@query("cv_stratified", f"WITH {_ROWS} SELECT row_id, class, (row_number() OVER (PARTITION BY class ORDER BY row_id) - 1) % 5 AS fold FROM f")
def cv_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return validation.stratified_k_fold(tables.features(spark, sf))


@query("cv_loo", f"WITH {_ROWS} SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS fold FROM f")
def cv_loo(spark: SparkSession, sf: str) -> DataFrame:
    return validation.leave_one_out(tables.features(spark, sf))


@query("cv_lpo", "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey")
def cv_lpo(spark: SparkSession, sf: str) -> DataFrame:
    return validation.leave_two_out(tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_id")))


@query("cv_shuffle", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT row_id, {r} AS split, row_number() OVER (ORDER BY {_PLACE.format(seed=r)}, row_id) <= ceil(count(*) OVER () * 20 / 100) AS is_test FROM f" for r in range(3)))
def cv_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return validation.shuffle_split(tables.features(spark, sf), 3)


# Ten components, squared and scaled to sum 1, are the probabilities of the ten classes.
_CLASSES = 10
_SCORED = "v AS (SELECT vec_id AS row_id, label AS own, list_transform(embedding[1:10], lambda x: x::DOUBLE * x::DOUBLE) AS w FROM embeddings), s AS (SELECT row_id, own, list_transform(w, lambda x: round(x / list_sum(w), 9)) AS scores FROM v)"
_BINARY = f"{_SCORED}, b AS (SELECT row_id, round(list_sum(scores[1:5]), 9) AS score, (own < 5)::INT AS label FROM s)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    w = F.transform(F.slice("embedding", 1, _CLASSES), lambda x: x.cast("double") * x.cast("double"))
    df = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("own"), w.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return df.select("row_id", "own", F.transform("w", lambda x: F.round(x / total, 9)).alias("scores"))


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("row_id", F.round(F.aggregate(F.slice("scores", 1, 5), F.lit(0.0), lambda a, x: a + x), 9).alias("score"), (F.col("own") < 5).cast("int").alias("label"))


_PREDICTED = f"{_SCORED}, p AS (SELECT row_id, own AS class, list_position(scores, list_max(scores)) - 1 AS prediction FROM s)"
_GROUPED = "l AS (SELECT class AS label FROM p UNION SELECT prediction FROM p), g AS (SELECT label, (SELECT count(*) FROM p WHERE class = label) AS a, (SELECT count(*) FROM p WHERE prediction = label) AS p, (SELECT count(*) FROM p WHERE class = label AND prediction = label) AS h FROM l)"
_SHARES = {"precision": ("h", "p"), "recall": ("h", "a"), "f1": ("2 * h", "a + p"), "jaccard": ("h", "a + p - h")}


def _averaged() -> str:
    parts = []
    for name, (x, y) in _SHARES.items():
        one = f"coalesce(({x}) / nullif({y}, 0), 0)"
        sums = [e.replace("a", "sum(a)").replace("p", "sum(p)").replace("h", "sum(h)") for e in (x, y)]
        parts += [f"SELECT '{name}' AS metric, 'micro' AS average, round(({sums[0]}) / ({sums[1]}), 6) AS value FROM g", f"SELECT '{name}', 'macro', round(avg({one}), 6) FROM g", f"SELECT '{name}', 'weighted', round(sum({one} * a) / sum(a), 6) FROM g"]
    parts += ["SELECT 'accuracy', '', round(sum(h) / sum(a), 6) FROM g", "SELECT 'balanced_accuracy', '', round(avg(h / a), 6) FROM g WHERE a > 0"]
    return f"WITH {_PREDICTED}, {_GROUPED} " + " UNION ALL ".join(parts)


@query("metrics_averages", _averaged())
def metrics_averages(spark: SparkSession, sf: str) -> DataFrame:
    best = F.array_position("scores", F.array_max("scores")) - 1
    return validation.averages(_scored(spark, sf).select(F.col("own").alias("class"), best.cast("int").alias("prediction")))




@query("roc_auc", f"WITH {_BINARY}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM b) SELECT round(((sum(rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)))::DOUBLE, 6) AS value FROM r")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return validation.roc_auc(_binary(spark, sf)).select(F.round("auc", 6).alias("value"))


@query("average_precision", f"WITH {_BINARY}, t AS (SELECT score, sum(label) AS p, count(*) AS n FROM b GROUP BY score), c AS (SELECT *, sum(p) OVER w AS hits, sum(n) OVER w AS all_ FROM t WINDOW w AS (ORDER BY score DESC)) SELECT round((sum(p * hits / all_) / sum(p))::DOUBLE, 6) AS value FROM c")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return validation.average_precision(_binary(spark, sf)).select(F.round("value", 6).alias("value"))


@query("score_losses", f"WITH {_BINARY}, c AS (SELECT greatest(1e-15, least(1 - 1e-15, score)) AS p, score, label FROM b), a AS (SELECT avg(-label * ln(p) - (1 - label) * ln(1 - p)) AS loss, avg((score - label) ** 2) AS brier, avg(label) AS s FROM c) SELECT round(-loss, 6) AS neg_log_loss, round(-brier, 6) AS neg_brier_score, round(1 - loss / (-s * ln(s) - (1 - s) * ln(1 - s)), 6) AS d2_log_loss FROM a")
def score_losses(spark: SparkSession, sf: str) -> DataFrame:
    df = validation.score_losses(_binary(spark, sf))
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("top_k_accuracy", f"WITH {_SCORED} SELECT round(avg((len(list_filter(scores, lambda x: x > scores[own + 1])) < 3)::INT), 6) AS value FROM s")
def top_k_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return validation.top_k_accuracy(_scored(spark, sf), 3).select(F.round("value", 6).alias("value"))


_RANKS = "rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS rank"
_OF_RANKS = "((sum(rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)))::DOUBLE"


@query(
    "roc_auc_multiclass",
    f"""WITH {_SCORED}, e AS (SELECT c, scores[c + 1] AS score, (own = c)::INT AS label FROM s, (SELECT unnest(range({_CLASSES})) AS c)),
er AS (SELECT c, label, {_RANKS.format(k='c')} FROM e), ovr AS (SELECT c, {_OF_RANKS} AS auc, sum(label) AS n FROM er GROUP BY c),
o AS (SELECT a, b, scores[a + 1] AS score, (own = a)::INT AS label FROM s, (SELECT x.c AS a, y.c AS b FROM (SELECT unnest(range({_CLASSES})) AS c) x, (SELECT unnest(range({_CLASSES})) AS c) y WHERE x.c <> y.c) WHERE own IN (a, b)),
orr AS (SELECT a, b, label, {_RANKS.format(k='a, b')} FROM o), oe AS (SELECT a, b, {_OF_RANKS} AS auc, count(*) AS n FROM orr GROUP BY a, b),
ovo AS (SELECT least(a, b), greatest(a, b), avg(auc) AS auc, max(n) AS n FROM oe GROUP BY 1, 2)
SELECT 'roc_auc_ovr' AS metric, round(avg(auc), 6) AS value FROM ovr UNION ALL SELECT 'roc_auc_ovr_weighted', round(sum(auc * n) / sum(n), 6) FROM ovr
UNION ALL SELECT 'roc_auc_ovo', round(avg(auc), 6) FROM ovo UNION ALL SELECT 'roc_auc_ovo_weighted', round(sum(auc * n) / sum(n), 6) FROM ovo""",
)
def roc_auc_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    return validation.multiclass_auc(_scored(spark, sf), _CLASSES).select("metric", F.round("value", 6).alias("value"))


@query("scan_model")
def scan_model(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier written to the shared folder and read again."""
    f = tables.features(spark, sf)
    path = tables.scratch(spark, "model")
    models.fit("logreg", f.where(models.held_out() > 0), max_iter=10).write().overwrite().save(path)
    return models.predict(PipelineModel.load(path), f)


@query("merge_features", f"WITH {_ROWS} SELECT 0 AS part, row_id, class FROM f WHERE class < '3' UNION ALL SELECT 1, row_id, class FROM f WHERE class BETWEEN '2' AND '5' UNION ALL SELECT 2, row_id, class FROM f WHERE class > '4'")
def merge_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature sets of several inputs, each class together."""
    f = tables.features(spark, sf)
    return models.concat_classes(f.where("class < '3'"), f.where("class between '2' and '5'"), f.where("class > '4'")).select("part", "row_id", "class")


def _kernelled(kernel: str) -> None:
    @query(f"clf_svm_{kernel}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = models.kernel_map(tables.features(spark, sf), kernel)
        return models.predict(models.fit("svm", f.where(models.held_out() > 0), max_iter=10), f)


_kernelled("poly")
_kernelled("sigmoid")


@query("validate_models")
def validate_models(spark: SparkSession, sf: str) -> DataFrame:
    return models.compare_models(("logreg", "rf"), tables.features(spark, sf), 2, max_iter=10, trees=5)


_SETS = "o AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS truth, coalesce(list(DISTINCT l_returnflag) FILTER (l_quantity > 25), []) AS guess FROM lineitem GROUP BY l_orderkey), s AS (SELECT len(list_intersect(truth, guess)) AS b, len(truth) AS n, len(guess) AS m FROM o)"


@query("metrics_samples", f"WITH {_SETS} SELECT round(avg(CASE WHEN m > 0 THEN b / m ELSE 0 END), 9) AS precision, round(avg(CASE WHEN n > 0 THEN b / n ELSE 0 END), 9) AS recall, round(avg(CASE WHEN n + m > 0 THEN 2 * b / (n + m) ELSE 0 END), 9) AS f1, round(avg(CASE WHEN n + m - b > 0 THEN b / (n + m - b) ELSE 0 END), 9) AS jaccard FROM s")
def metrics_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The flags of an order, guessed from its larger lines: averages over orders."""
    lines = tables.table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity")
    sets = lines.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("truth"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("guess"))
    found = validation.samples_averages(sets)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])
