"""Fold tables, and metrics of predictions and scores, as DataFrame plans.

Ranks and running sums over a whole table are made in slices: cut points of the
sort key from ``approxQuantile``, sums per slice, then a window inside each
slice. So no task sorts all rows, and the result doesn't depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def _sliced(df: DataFrame, key: str, slices: int) -> DataFrame:
    """``df`` with ``__slice``, which grows with the numeric column ``key``."""
    cuts = sorted(set(df.approxQuantile(key, [i / slices for i in range(1, slices)], 0.25 / slices)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    return df.withColumn("__slice", place)


def running(df: DataFrame, key: str, sums: dict[str, str], by: Sequence[str] = (), ties: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """``df`` with, for each ``out: column`` of ``sums``, the sum of the column over the rows before (in order of ``key``, ``ties``) within ``by``."""
    df = _sliced(df, key, slices)
    totals = df.groupBy(*by, "__slice").agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])  # a row for each slice and group
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__slice", *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in sums])
    inside = Window.partitionBy(*by, "__slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, [*by, "__slice"])
    return out.withColumns({o: F.col(f"__{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()}).drop("__slice", *[f"__{o}" for o in sums])


def ranked(df: DataFrame, key: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with its rank ``rn`` from 0 in order of ``key`` within ``by``."""
    return running(df.withColumn("__one", F.lit(1)), key, {"rn": "__one"}, by, ties).drop("__one")


def shuffled(seed: int, key: str = "row_id") -> Column:
    """A number that stands for the place of a row in an order drawn with ``seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")


def _contiguous(rn: Column, n: Column, k: int) -> Column:
    """The fold of rank ``rn`` of ``n``: the first ``n % k`` folds hold one row more."""
    size, more = F.floor(n / k), n % k
    return F.when(rn < (size + 1) * more, F.floor(rn / (size + 1))).otherwise(F.floor((rn - more) / size)).cast("long")


def k_fold(rows: DataFrame, k: int = 5, seed: int | None = None) -> DataFrame:
    """(row_id, fold): contiguous folds in order of the id, or of a shuffle by ``seed``."""
    n = rows.count()
    df = rows.select("row_id") if seed is None else rows.select("row_id", shuffled(seed).alias("__key"))
    df = ranked(df, "row_id" if seed is None else "__key", ties=() if seed is None else ("row_id",))
    return df.select("row_id", _contiguous(F.col("rn"), F.lit(n), k).alias("fold"))


def repeated_k_fold(rows: DataFrame, k: int = 5, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(row_id, repeat, fold): a shuffle of its own for each repeat."""
    out = None
    for r in range(repeats):
        one = k_fold(rows, k, seed + r).withColumn("repeat", F.lit(r).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out.select("row_id", "repeat", "fold")


def stratified_k_fold(rows: DataFrame, k: int = 5) -> DataFrame:
    """(row_id, class, fold): each class dealt out in turn."""
    return ranked(rows.select("row_id", "class"), "row_id", by=("class",)).select("row_id", "class", (F.col("rn") % k).alias("fold"))


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(row_id, fold): each row is a fold."""
    return ranked(rows.select("row_id"), "row_id").select("row_id", F.col("rn").cast("long").alias("fold"))


def leave_two_out(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """(a, b): every two rows that are left out together; more splits than ``most`` are refused, as each is a model to fit."""
    n = rows.count()
    if n * (n - 1) // 2 > most:
        raise ValueError(f"{n * (n - 1) // 2} splits; at most {most} are made")
    return rows.select(F.col("row_id").alias("a")).join(rows.select(F.col("row_id").alias("b")), F.col("a") < F.col("b"))


def shuffle_split(rows: DataFrame, splits: int = 10, percent: int = 20, seed: int = 0) -> DataFrame:
    """(row_id, split, is_test): ``percent`` of the rows, rounded up, drawn for each split."""
    n, out = rows.count(), None
    for r in range(splits):
        one = ranked(rows.select("row_id", shuffled(seed + r).alias("__key")), "__key", ties=("row_id",))
        one = one.select("row_id", F.lit(r).cast("long").alias("split"), (F.col("rn") < -(-n * percent // 100)).alias("is_test"))
        out = one if out is None else out.unionByName(one)
    return out


def averages(predictions: DataFrame) -> DataFrame:
    """(metric, average, value): precision, recall, F1 and Jaccard index, micro, macro and weighted; accuracy, balanced accuracy.

    From one count of (class, prediction); a share of nothing is 0, a class that is only predicted counts with no rows of its own.
    """
    c = predictions.groupBy("class", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("class") == F.col("prediction"), F.col("n")).otherwise(0)
    ends = c.select(F.col("class").alias("label"), F.col("n").alias("actual"), F.lit(0).alias("guessed"), hit.alias("hit"))
    ends = ends.union(c.select("prediction", F.lit(0), "n", F.lit(0)))
    g = ends.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("actual", "guessed", "hit")])
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    of = {
        "precision": lambda a, p, h: share(h, p),
        "recall": lambda a, p, h: share(h, a),
        "f1": lambda a, p, h: share(2 * h, a + p),
        "jaccard": lambda a, p, h: share(h, a + p - h),
    }
    own, total = (F.col("actual"), F.col("guessed"), F.col("hit")), (F.sum("actual"), F.sum("guessed"), F.sum("hit"))
    found = []
    for name, f in of.items():
        found += [(name, "micro", f(*total)), (name, "macro", F.avg(f(*own))), (name, "weighted", F.sum(f(*own) * F.col("actual")) / F.sum("actual"))]
    found += [("accuracy", "", share(F.sum("hit"), F.sum("actual"))), ("balanced_accuracy", "", F.avg(F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))))]
    one = g.agg(*[v.alias(f"m{i}") for i, (_, _, v) in enumerate(found)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).alias("average"), F.round(f"m{i}", 6).alias("value")) for i, (m, a, _) in enumerate(found)])).alias("r")).select("r.*")


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, positives, negatives, auc) of (score, label 0 or 1): the share of pairs in order, equal ones counting half."""
    each = scores.groupBy(*by, "score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q"))
    below = running(each, "score", {"under": "q"}, by)
    out = below.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)).alias("u"))
    return out.select(*by, "positives", "negatives", (F.col("u") / F.when(F.col("positives") * F.col("negatives") > 0, F.col("positives") * F.col("negatives"))).alias("auc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): precision at each threshold, weighted by the recall that it adds."""
    each = scores.groupBy(*by, "score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    above = running(each.withColumn("score", -F.col("score")), "score", {"hits": "p", "all": "n"}, by)
    gain = F.col("p") * (F.col("hits") + F.col("p")) / (F.col("all") + F.col("n"))
    return above.groupBy(*by).agg((F.sum(gain) / F.when(F.sum("p") > 0, F.sum("p"))).alias("value"))


def score_losses(scores: DataFrame) -> DataFrame:
    """(neg_log_loss, neg_brier_score, d2_log_loss) of (score, label), scores as probabilities."""
    p, y = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score"))), F.col("label")
    row = scores.agg(F.avg(-y * F.ln(p) - (1 - y) * F.ln(1 - p)).alias("loss"), F.avg((F.col("score") - y) ** 2).alias("brier"), F.avg(y.cast("double")).alias("share"))
    s = F.col("share")
    null = -s * F.ln(s) - (1 - s) * F.ln(1 - s)
    return row.select((-F.col("loss")).alias("neg_log_loss"), (-F.col("brier")).alias("neg_brier_score"), (1 - F.col("loss") / F.when((s > 0) & (s < 1), null)).alias("d2_log_loss"))


def top_k_accuracy(scored: DataFrame, k: int) -> DataFrame:
    """(value) of (own: index of the class, scores: array): shares of rows whose class has fewer than ``k`` greater scores."""
    own = F.get("scores", F.col("own"))
    return scored.agg(F.avg((F.size(F.filter("scores", lambda x: x > own)) < k).cast("double")).alias("value"))


def one_vs_rest(scored: DataFrame, classes: int) -> DataFrame:
    """(class, score, label): each row once for each class."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("class"), F.get("scores", c).alias("score"), (F.col("own") == c).cast("int").alias("label"))))
    return scored.select(each.alias("r")).select("r.*")


def multiclass_auc(scored: DataFrame, classes: int) -> DataFrame:
    """(metric, value): ROC AUC one against the rest and one against one, each plain and weighted by class size."""
    rest = roc_auc(one_vs_rest(scored, classes), ("class",))
    ovr = rest.agg(F.avg("auc").alias("roc_auc_ovr"), (F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc_ovr_weighted"))
    # a row meets each other class once from each side
    pairs = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("c"), F.get("scores", F.col("own")).alias("mine"), F.get("scores", c).alias("other"))), lambda x: x["c"] != F.col("own")))
    met = scored.select("own", pairs.alias("r")).select("own", "r.*")
    # AUC(a | b): rows of a are positive by the score of a, rows of b negative by the score of a
    sides = met.select(F.col("own").alias("a"), F.col("c").alias("b"), F.col("mine").alias("score"), F.lit(1).alias("label")).union(met.select(F.col("c"), F.col("own"), F.col("other"), F.lit(0)))
    each = roc_auc(sides, ("a", "b"))
    both = each.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.avg("auc").alias("auc"), F.max(F.col("positives") + F.col("negatives")).alias("n"))
    ovo = both.agg(F.avg("auc").alias("roc_auc_ovo"), (F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("roc_auc_ovo_weighted"))
    out = []
    for df in (ovr, ovo):
        out += [df.select(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def samples_averages(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Precision, recall, F1 and Jaccard's index of sets of labels (arrays), computed row by row and averaged; a score without a denominator is 0."""
    a, b = F.array_distinct(F.coalesce(truth, F.array())), F.array_distinct(F.coalesce(guess, F.array()))
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    scores = {"precision": share(both, m), "recall": share(both, n), "f1": share(2 * both, n + m), "jaccard": share(both, n + m - both)}
    return rows.select(*[c.alias(k) for k, c in scores.items()]).agg(*[F.avg(k).alias(k) for k in scores])
