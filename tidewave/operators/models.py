"""Class-tagged features: union, FBCSP, classifiers, validation."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import densities, kernels
from tidewave.operators import filterbank
from tidewave.sources.tables import stored


#: Machines of a one-against-rest classifier that are fitted at a time, each with a copy of the features in executors' memory or on disk.
MACHINES = 4


def concat_classes(*parts: DataFrame) -> DataFrame:
    """Rows of all parts (row_id, class, x), each class together, parts in order inside a class."""
    first, *rest = [p.select(F.lit(i).alias("part"), "row_id", "class", "x") for i, p in enumerate(parts)]
    for p in rest:
        if p.schema["x"].dataType != first.schema["x"].dataType:
            raise ValueError("parts must have the same features")
        first = first.unionByName(p)
    return first


def class_ranges(features: DataFrame) -> DataFrame:
    """(class, start, stop): where each class stands when rows are put together by class."""
    counts = features.groupBy("class").agg(F.count("*").alias("n"))  # one row per class
    w = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("class", (F.sum("n").over(w) - F.col("n")).alias("start"), F.sum("n").over(w).alias("stop"))


def held_out(parts: int = 5) -> F.Column:
    """A row's fold, by hash of its id."""
    return F.pmod(F.crc32(F.col("row_id").cast("string")), F.lit(parts))


def _prepared(features: DataFrame) -> DataFrame:
    return features.withColumn("features", array_to_vector("x"))


def classifier(kind: str, **options: object) -> Pipeline:
    """A pipeline from (class, x): ``logreg``, ``svm`` (linear; ``rbf=True``: random Fourier features, an approximation), ``rf``."""
    index = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = {
        "logreg": lambda: LogisticRegression(maxIter=options.get("max_iter", 50), regParam=options.get("reg", 0.01), elasticNetParam=options.get("l1_ratio", 0.0), standardization=False),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=options.get("max_iter", 30), regParam=options.get("reg", 0.01)), parallelism=MACHINES),
        "rf": lambda: RandomForestClassifier(numTrees=options.get("trees", 20), maxDepth=min(30, options.get("depth", 5)), impurity=options.get("criterion", "gini"), seed=options.get("seed", 7)),
    }[kind]()
    return Pipeline(stages=[index, model])


def random_fourier(features: DataFrame, size: int = 100, gamma: float | None = None, seed: int = 3) -> DataFrame:
    """``x`` mapped so that inner products approximate the RBF kernel (Rahimi and Recht 2007)."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = np.stack(x.tolist())
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((m.shape[1], size)) * np.sqrt(2 * (gamma or 1 / m.shape[1]))
        return pd.Series((np.sqrt(2 / size) * np.cos(m @ w + rng.uniform(0, 2 * np.pi, size))).tolist())

    return features.withColumn("x", run("x"))


def kernel_map(features: DataFrame, kernel: str = "poly", landmarks: int = 50, gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> DataFrame:
    """``x`` as its kernel values with ``landmarks`` rows drawn by hash, so that a linear machine has the kernel's shapes (an approximation)."""
    some = features.select("row_id", "x").orderBy(F.xxhash64("row_id"), "row_id").limit(landmarks).toPandas()
    centres = np.stack(some["x"].tolist())
    g = gamma or 1 / centres.shape[1]

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        inner = g * (np.stack(x.tolist()) @ centres.T) + coef0
        return pd.Series(((inner**degree) if kernel == "poly" else np.tanh(inner)).tolist())

    return features.withColumn("x", run("x"))


def fit(kind: str, features: DataFrame, **options: object) -> PipelineModel:
    return classifier(kind, **options).fit(_prepared(features))


def predict(model: PipelineModel, features: DataFrame, *more: str) -> DataFrame:
    """(row_id, class, ``more``, prediction): the predicted class by name."""
    labels = model.stages[0].labels
    out = model.transform(_prepared(features))
    return out.select("row_id", "class", *more, F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1).alias("prediction"))


def class_sums(features: DataFrame) -> DataFrame:
    """(class, v): of each class the number of rows, the sums of the features and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                codes = batch["class"].dictionary_encode()
                at, x = codes.indices.to_numpy(), batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    own = x[at == k]
                    held[name] = held.get(name, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["class", "v"])

    parts = features.where("class is not null").select("class", "x").mapInArrow(run, "class string, v array<double>").select("class", F.posexplode("v").alias("i", "v"))
    total = parts.groupBy("class", "i").agg(F.sum("v").alias("v"))
    return total.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("class", F.col("c.v").alias("v"))


@dataclass
class Discriminant:
    """Fisher's linear discriminant: class means and a pooled covariance, from one aggregation."""

    classes: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    means: np.ndarray
    pooled: np.ndarray

    @classmethod
    def fit(cls, features: DataFrame, shrinkage: float = 1e-3) -> Discriminant:
        """Each task sums x and x xT of its own rows by class; the driver gets features squared per class."""
        rows = {r["class"]: np.array(r["v"]) for r in class_sums(features).collect()}
        classes = sorted(rows)
        v = np.array([rows[c] for c in classes])
        k = int((np.sqrt(4 * v.shape[1] - 3) - 1) / 2)
        n, means = v[:, 0], v[:, 1 : k + 1] / v[:, :1]
        pooled = (v[:, k + 1 :].sum(0).reshape(k, k) - (means.T * n) @ means) / max(1, n.sum() - len(classes))
        shrunk = (1 - shrinkage) * pooled + shrinkage * np.trace(pooled) / k * np.eye(k)
        w = np.linalg.solve(shrunk, means.T).T
        return cls(classes, w, np.log(n / n.sum()) - 0.5 * (w * means).sum(1), means, pooled)

    def predict(self, features: DataFrame) -> DataFrame:
        classes, w, b = self.classes, self.weights, self.offsets

        @F.pandas_udf("string")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(np.array(classes, object)[(np.stack(x.tolist()) @ w.T + b).argmax(1)] if len(x) else [], dtype=object)

        return features.select("row_id", "class", run("x").alias("prediction"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("class", "prediction").agg(F.count("*").alias("n"))


def metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, and the accuracy over all."""
    c = confusion(predictions)
    hit = F.coalesce(F.sum(F.when(F.col("class") == F.col("prediction"), F.col("n"))), F.lit(0))
    actual = c.groupBy("class").agg(F.sum("n").alias("actual"), hit.alias("hit"))
    guessed = c.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("guessed"))
    total = actual.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"))
    df = actual.join(guessed, "class", "left").crossJoin(F.broadcast(total))  # one row
    precision, recall = F.col("hit") / F.col("guessed"), F.col("hit") / F.col("actual")
    return df.select("class", F.coalesce(precision, F.lit(0.0)).alias("precision"), recall.alias("recall"), F.coalesce(2 * precision * recall / F.when(precision + recall > 0, precision + recall), F.lit(0.0)).alias("f1"), "accuracy")


def cross_validate(kind: str, features: DataFrame, folds: int = 3, **options: object) -> DataFrame:
    """(fold, train_score, test_score) of a k-fold validation."""
    out, keyed = None, features.withColumn("fold", held_out(folds))
    for k in range(folds):
        model = fit(kind, keyed.where(F.col("fold") != k), **options)
        scored = predict(model, keyed, "fold")
        right = (F.col("class") == F.col("prediction")).cast("double")
        row = scored.agg(F.lit(k).alias("fold"), F.avg(F.when(F.col("fold") != k, right)).alias("train_score"), F.avg(F.when(F.col("fold") == k, right)).alias("test_score"))
        out = row if out is None else out.unionByName(row)
    return out


def compare_models(kinds: Sequence[str], features: DataFrame, folds: int = 3, **options: object) -> DataFrame:
    """(model, mean_train, mean_test) of several classifiers over the same folds."""
    out = None
    for kind in kinds:
        row = cross_validate(kind, features, folds, **options).agg(F.lit(kind).alias("model"), F.avg("train_score").alias("mean_train"), F.avg("test_score").alias("mean_test"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- filter-bank common spatial patterns -------------------------------------------------


@dataclass
class FBCSP:
    """Filters of each band (rows: components) and the selected features (band, index)."""

    classes: list[str]
    filters: dict[int, np.ndarray]
    selected: list[tuple[int, int]]
    m: int = 2

    @classmethod
    def fit(cls, trials: DataFrame, m: int = 2, n_features: int = 4) -> FBCSP:
        """``trials``: (trial_id, class, band, seq, x: array over channels); exactly two classes."""
        return cls.fit_covariances(filterbank.raw_covariances(trials), m, n_features)

    @classmethod
    def fit_covariances(cls, cov: DataFrame, m: int = 2, n_features: int = 4) -> FBCSP:
        """``cov``: (trial_id, class, band, cov), read twice; exactly two classes. Filters and selection come from all trials."""
        rows = averaged(cov).collect()  # channels squared for each class and band
        classes = sorted({r["class"] for r in rows})
        if len(classes) != 2:
            raise ValueError("two classes are needed")
        by = {(r["class"], r["band"]): np.array(r["cov"]).reshape(int(len(r["cov"]) ** 0.5), -1) for r in rows}
        filters = {b: kernels.csp(by[classes[0], b], by[classes[1], b]) for b in sorted({b for _, b in by})}
        model = cls(classes, filters, [], m)
        score = mutual_information(stored(model._all_features(cov), "features"), classes)
        bands, own = sorted(filters), 2 * m
        best = sorted(score, key=lambda j: (-round(score[j], 10), j))[:n_features]  # the order of the sums doesn't decide
        both = {*best, *(j // own * own + own - 1 - j % own for j in best)}
        model.selected = [(bands[j // own], j % own) for j in sorted(both)]
        return model

    def _all_features(self, cov: DataFrame) -> DataFrame:
        """(trial_id, class, f): log variance shares of the first and last ``m`` components of all bands; trials that lack a band go."""
        filters, m, bands = self.filters, self.m, sorted(self.filters)

        @F.pandas_udf("array<double>")
        def shares(band: pd.Series, cov: pd.Series) -> pd.Series:
            out, own = np.empty((len(band), 2 * m)), band.to_numpy()
            for b in np.unique(own):
                w = filters[b][np.r_[0:m, len(filters[b]) - m : len(filters[b])]]
                c = np.stack(cov[own == b].tolist()).reshape(-1, w.shape[1], w.shape[1])
                var = np.einsum("ij,tjk,ik->ti", w, c, w)
                out[own == b] = np.log(var / var.sum(1, keepdims=True))
            return pd.Series(list(out), dtype=object)

        each = cov.where(F.col("band").isin(bands)).select("trial_id", "class", "band", shares("band", "cov").alias("f"))
        whole = each.groupBy("trial_id", "class").agg(F.array_sort(F.collect_list(F.struct("band", "f"))).alias("bands"))
        return whole.where(F.size("bands") == len(bands)).select("trial_id", "class", F.flatten(F.transform("bands", lambda r: r["f"])).alias("f"))

    def transform(self, trials: DataFrame) -> DataFrame:
        """(row_id, class, x) with the selected features, named ``fcsp_band{b}_f{j}``."""
        return self.transform_covariances(filterbank.raw_covariances(trials))

    def transform_covariances(self, cov: DataFrame) -> DataFrame:
        bands = sorted(self.filters)
        at = [bands.index(b) * 2 * self.m + j for b, j in self.selected]
        return self._all_features(cov).select(F.col("trial_id").alias("row_id"), "class", F.array(*[F.col("f")[j] for j in at]).alias("x"))

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "m": self.m, "filters": {str(b): w.tolist() for b, w in self.filters.items()}, "selected": self.selected})

    @classmethod
    def from_json(cls, text: str) -> FBCSP:
        d = json.loads(text)
        return cls(d["classes"], {int(b): np.array(w) for b, w in d["filters"].items()}, [tuple(s) for s in d["selected"]], d["m"])


def mean_covariances(trials: DataFrame, channels: int | None = None) -> DataFrame:
    """(class, band, cov): means over trials of the covariances of their ``channels`` (none: as many as the first row has), each an aggregate; a trial of one sample has none."""
    if channels is None:
        first = trials.select(F.size("x")).first()
        channels = first[0] if first else 0
    return averaged(filterbank.raw_covariances(trials, channels))


def averaged(cov: DataFrame) -> DataFrame:
    """(class, band, cov): mean over trials, elementwise by aggregation."""
    cells = cov.select("class", "band", F.posexplode("cov").alias("i", "v"))
    means = cells.groupBy("class", "band", "i").agg(F.avg("v").alias("v"))
    return means.groupBy("class", "band").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("class", "band", F.transform("c", lambda r: r["v"]).alias("cov"))


def mutual_information(features: DataFrame, classes: list[str]) -> dict[int, float]:
    """Between each of the features ``f`` (read three times) and the two ``classes``, with Parzen windows over all rows (Ang et al. 2008).

    A value that is not finite has no window and is left out for its feature. The driver holds a few numbers for each
    cell of a window's width (``densities``), however many rows there are.
    """
    values = features.select("class", F.posexplode("f").alias("j", "v")).where(F.abs("v") < float("inf"))
    found = {(r["j"], classes.index(r["class"])): (r["n"], r["s"]) for r in values.groupBy("class", "j").agg(F.count("*").alias("n"), F.stddev_pop("v").alias("s")).collect()}
    width = {key: float(densities.bandwidth(s, n)) for key, (n, s) in found.items()}
    cells = {key: densities.spread(*c) for key, c in _moments(features, classes, width).items()}
    shared = features.sparkSession.sparkContext.broadcast(cells)
    size = max((j for j, _ in found), default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for j, x in enumerate(_table(batch).T[:size]):
                x = x[np.isfinite(x)]
                a, b = (densities.at(x, width[j, k], *shared.value[j, k]) / width[j, k] if (j, k) in width else np.zeros(len(x)) for k in (0, 1))
                total[j] += _entropy(a / np.maximum(a + b, 1e-300)).sum()
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["e"])

    entropy = np.sum([np.array(r["e"]) for r in features.select("f").mapInArrow(run, "e array<double>").collect()], axis=0)  # a row for each task
    shared.unpersist()
    counts = np.array([[found.get((j, k), (0, 0))[0] for k in (0, 1)] for j in range(size)]).reshape(size, 2)
    rows = np.maximum(1, counts.sum(1))
    return {j: float(_entropy(counts[j, 0] / rows[j]) - entropy[j] / rows[j]) for j in range(size)}


def _entropy(q: np.ndarray | float) -> np.ndarray | float:
    q = np.clip(q, 1e-12, 1 - 1e-12)
    return -(q * np.log(q) + (1 - q) * np.log(1 - q))


def _table(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by features."""
    return batch["f"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _moments(features: DataFrame, classes: list[str], width: dict[tuple[int, int], float]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each feature and class the cells that hold values, with their moments: each task sums its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch["class"].to_numpy(zero_copy_only=False)
            tables = [_table(batch)[label == c] for c in classes]
            for key, h in width.items():
                x = tables[key[1]][:, key[0]]
                own = densities.summed(*densities.placed(x[np.isfinite(x)], h))
                held[key] = densities.summed(*map(np.concatenate, zip(held[key], own))) if key in held else own
        for (j, k), (cell, terms) in held.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * densities.TERMS), pa.array(terms.ravel()))
            yield pa.record_batch([pa.array(np.full(len(cell), j, np.int32)), pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), lists], ["j", "k", "cell", "m"])

    parts = features.mapInArrow(run, "j int, k int, cell long, m array<double>")
    total = parts.groupBy("j", "k", "cell").agg(*[F.sum(F.get("m", F.lit(i))).alias(f"m{i}") for i in range(densities.TERMS)]).toPandas()
    m = total[[f"m{i}" for i in range(densities.TERMS)]].to_numpy()
    return {key: (total["cell"].to_numpy()[at], m[at]) for key, at in total.groupby(["j", "k"]).indices.items()}


def top_features(scores: DataFrame, n: int, m: int) -> DataFrame:
    """The ``n`` best (band, j, mi) and the twin 2m-1-j of each, in order of band and j."""
    best = scores.orderBy(F.desc("mi"), "band", "j").limit(n)
    twins = best.select("band", (2 * m - 1 - F.col("j")).alias("j"))
    return best.select("band", "j").union(twins).distinct()
