"""Operator 5: mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A total token budget flows down it: at
each node the children share the node's budget by weight, a child that cannot
hold its share keeps what it can, and what it leaves goes to its siblings. As a
node's own capacity bounds what it is given, a shortage reaches an ancestor's
siblings only when all siblings below are full.

A leaf with budget b takes whole epochs of its documents and then a prefix of
one more epoch, in an order seeded per epoch: the documents whose running token
count stays within what is left. Running counts are found in two steps (sums
per slice of the seeded order, then inside the one slice where the prefix
ends), so no leaf is ever gathered in one task.

Null, empty and blank texts have no words and take part in nothing; a text of any
length counts whole. A null language or source is its own leaf, called
``(none)``. Repeated rows of an id are separate rows with the same place in the
order, the shorter first; so are rows without an id. A weight that is not given
is 1. An empty table gives none; further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import materialize, plain_names, unused, words

NONE = "(none)"
LEVELS = ("domain", "language", "leaf_source")


@dataclass(frozen=True)
class Plan:
    """Targets: ``percent`` of all tokens is the budget, no document is taken more than ``epochs`` times."""

    percent: int = 60
    epochs: int = 2
    seed: int = 11
    rows_per_slice: int = 2000
    domains: int = 4
    domain_weights: dict[str, int] = field(default_factory=lambda: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1})
    language_weights: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})


def domain_of(source: Column, domains: int) -> Column:
    """A source's domain: its trailing number modulo ``domains``; 0 without one."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.concat(F.lit("domain"), (number % domains).cast("string"))


def _weight(key: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, value in weights.items():
        out = F.when(F.col(key) == name, value).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], given: str) -> DataFrame:
    """``given`` (per parent) shared among its children: min(cap, level * weight).

    In order of cap / weight the children fill up one after another; the level
    is what is left over the weights that are left, at the first child that the
    level does not fill. All siblings full: each gets its capacity.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "key")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumns({
        "before": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
        "rest": F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
    })
    df = df.withColumn("level", (F.col(given) - F.col("before")).cast("double") / F.col("rest"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    df = df.withColumn("water", F.max(fits).over(Window.partitionBy(*parent)))
    share = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("water") * F.col("weight"))))
    return df.withColumn("budget", share.cast("long")).drop("before", "rest", "level", "water")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves`` (domain, language, leaf_source, tokens) with each leaf's ``budget``."""
    weights = {"domain": _weight("domain", plan.domain_weights), "language": _weight("language", plan.language_weights), "leaf_source": F.lit(1).cast("long")}
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(F.floor(F.col("all") * plan.percent / 100).cast("long").alias("given"))
    above, given = total.withColumn("root", F.lit(0)), "given"
    parent = ["root"]
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = leaves.withColumn("root", F.lit(0)).groupBy("root", *keys).agg((F.sum("tokens") * plan.epochs).alias("cap"))
        nodes = nodes.withColumns({"weight": weights[level], "key": F.col(level)})
        shared = _share(nodes.join(above.select(*parent, given), parent), parent, given)
        above = shared.select("root", *keys, F.col("budget").alias("given"))
        parent = ["root", *keys]
    return leaves.join(above.drop("root").withColumnRenamed("given", "budget"), list(LEVELS))


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """One row per document that is taken: doc_id, its leaf, tokens and ``copies``."""
    order = F.md5(F.concat_ws("-", F.lit(plan.seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit(NONE)).alias("language"),
        F.coalesce("source", F.lit(NONE)).alias("leaf_source"),
        domain_of(F.coalesce("source", F.lit("")), plan.domains).alias("domain"),
        F.size(words(F.col("text"))).cast("long").alias("tokens"),
    ).where("tokens > 0")
    base = materialize(base, "mixing-tokens")  # narrow rows: ids, leaf and counts, no text
    leaves = base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    planned = materialize(budgets(leaves, plan), "mixing-budgets")
    planned = planned.select(
        *LEVELS,
        F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("epoch"),
        (F.col("budget") % F.col("tokens")).alias("left"),
        F.ceil(F.col("rows") / plan.rows_per_slice).cast("long").alias("slices"),
    )
    placed = base.join(planned, list(LEVELS)).withColumn("place", order)
    placed = placed.withColumn("slice", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 32)).cast("long"))
    sums = placed.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*LEVELS, "slice", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("before"), "sum")
    before = materialize(before, "mixing-slices")
    df = placed.join(before, [*LEVELS, "slice"])
    whole, cut = F.col("before") + F.col("sum") <= F.col("left"), F.col("before") < F.col("left")
    inside = Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    split = df.where(~whole & cut).withColumn("last", (F.col("before") + F.sum("tokens").over(inside) <= F.col("left")).cast("long"))
    rest = df.where(whole | ~cut).withColumn("last", whole.cast("long"))
    out = split.unionByName(rest).withColumn("copies", F.col("epoch") + F.col("last"))
    return out.where("copies > 0").select("doc_id", "domain", "language", F.col("leaf_source").alias("source"), "tokens", "copies")


def take(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """``docs`` reduced to what ``mix`` takes, with ``copies`` (``_copies`` if there is such a column).

    Of rows that agree in id, leaf and length as many are taken, and as often,
    as ``mix`` says, in order of the hash of their text. Further columns may have
    any name.
    """
    return _taken(plain_names(docs), plan).toDF(*docs.columns, unused("copies", docs.columns))


def _taken(docs: DataFrame, plan: Plan) -> DataFrame:
    copies, key, most, many, all_, row = (unused(c, docs.columns) for c in ("copies", "key", "most", "many", "all", "row"))
    taken = mix(docs, plan).groupBy(F.xxhash64("doc_id", "language", "source", "tokens").alias(key))
    taken = taken.agg(F.count("*").alias(all_), F.max("copies").alias("hi"), F.min("copies").alias("lo"), F.sum("copies").alias("sum"))
    # the copies of equal rows differ by one at most
    many_ = F.when(F.col("hi") > F.col("lo"), F.col("sum") - F.col(all_) * F.col("lo")).otherwise(F.col(all_))
    taken = taken.select(key, F.col("hi").alias(most), many_.alias(many), all_)
    tokens = F.size(words(F.col("text"))).cast("long")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("lang", F.lit(NONE)), F.coalesce("source", F.lit(NONE)), tokens))
    found = keyed.join(taken, key).withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text"))))
    found = found.where(F.col(row) <= F.col(all_)).withColumn(copies, F.when(F.col(row) <= F.col(many), F.col(most)).otherwise(F.col(most) - 1))
    return found.select(*docs.columns, copies)


def oracle(plan: Plan = Plan()) -> str:  # noqa: B008
    """DuckDB SQL for ``mix`` over the table ``documents``."""

    def weight(key: str, weights: dict[str, int]) -> str:
        return "(CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END)"

    chosen = {"domain": weight("domain", plan.domain_weights), "language": weight("language", plan.language_weights), "leaf_source": "1"}
    ctes = [
        rf"""base AS (SELECT doc_id, coalesce(lang, '{NONE}') AS language, coalesce(source, '{NONE}') AS leaf_source,
 'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % {plan.domains}) AS domain,
 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM documents)""",
        "leaves AS (SELECT domain, language, leaf_source, sum(tokens)::BIGINT AS tokens FROM base WHERE tokens > 0 GROUP BY ALL)",
        f"above AS (SELECT 0 AS root, floor(sum(tokens)::BIGINT * {plan.percent} / 100)::BIGINT AS given FROM leaves)",
    ]
    above, parent = "above", ["root"]
    for i, level in enumerate(LEVELS):
        keys, p = LEVELS[: i + 1], ", ".join(parent)
        ctes.append(f"n{i} AS (SELECT 0 AS root, {', '.join(keys)}, (sum(tokens) * {plan.epochs})::BIGINT AS cap, {chosen[level]} AS weight FROM leaves GROUP BY {', '.join(keys)})")
        ctes.append(f"o{i} AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS before, sum(weight) OVER (PARTITION BY {p}) - coalesce(sum(weight) OVER w, 0) AS rest FROM n{i} JOIN {above} USING ({p}) WINDOW w AS (PARTITION BY {p} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        ctes.append(f"l{i} AS (SELECT *, (given - before)::DOUBLE / rest AS level FROM o{i})")
        ctes.append(f"w{i} AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER (PARTITION BY {p}) AS water FROM l{i})")
        ctes.append(f"b{i} AS (SELECT root, {', '.join(keys)}, (CASE WHEN water IS NULL THEN cap ELSE least(cap, floor(water * weight)) END)::BIGINT AS given FROM w{i})")
        above, parent = f"b{i}", ["root", *keys]
    ctes += [
        "planned AS (SELECT l.*, given // tokens AS epoch, given % tokens AS remain FROM leaves l JOIN b2 USING (domain, language, leaf_source))",
        f"placed AS (SELECT b.*, epoch, remain, md5('{plan.seed}-' || epoch || '-' || coalesce(doc_id::VARCHAR, '')) AS place FROM base b JOIN planned USING (domain, language, leaf_source) WHERE b.tokens > 0)",
        "run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, leaf_source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM placed)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, domain, language, leaf_source AS source, tokens, (epoch + (CASE WHEN upto <= remain THEN 1 ELSE 0 END))::BIGINT AS copies FROM run WHERE epoch + (CASE WHEN upto <= remain THEN 1 ELSE 0 END) > 0"
