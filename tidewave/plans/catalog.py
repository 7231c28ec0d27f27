"""Registry of the signal-analytics queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions import kernels, statistics
from tidewave.operators import filterbank, models, signals
from tidewave.plans.registry import ORACLES, QUERIES, query
from tidewave.sources import generators, tables, xdf
from tidewave.streaming import online, stateful

_SAMPLES = "samples AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq, ts, event_type AS channel, value FROM events)"
_MARKERS = "markers AS (SELECT user_id AS signal_id, event_type AS marker, ts AS marker_ts FROM events WHERE event_type = 'purchase')"
_BOUNDS = "bounds AS (SELECT signal_id, min(ts) AS first_ts, max(ts) AS last_ts FROM samples GROUP BY signal_id)"
_WIDE = "wide AS (SELECT l_suppkey AS signal_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, l_returnflag AS class, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT signal_id, seq, class, '{c}' AS channel, {c} AS value FROM wide" for c in tables.CHANNELS) + ")"
_DAY = 86_400.0


# ---- sources -----------------------------------------------------------------------------


@query("scan_csv", "SELECT event_id, user_id, event_type, value FROM events")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.scratch(spark, "csv")
    tables.table(spark, sf, "events", "event_id", "user_id", "event_type", "value").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("event_id long, user_id long, event_type string, value double").csv(path)


@query("xdf_roundtrip", f"WITH {_SAMPLES} SELECT CAST(signal_id AS VARCHAR) AS stream, seq, epoch_us(ts) / 1000000.0::DOUBLE AS ts, channel, value FROM samples WHERE channel = 'purchase'")
def xdf_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.samples(spark, sf).where("channel = 'purchase'")
    rows = s.select(F.col("signal_id").cast("string").alias("stream"), "seq", (signals.micros("ts") / 1e6).alias("ts"), "channel", "value")
    return xdf.files(rows, 0.0).select("content").mapInPandas(lambda it: xdf.decode_all(c for b in it for c in b["content"]), xdf.SCHEMA).drop("text")


@query("xdf_roundtrip_all", f"WITH {_SAMPLES} SELECT CAST(signal_id AS VARCHAR) AS stream, seq, epoch_us(ts) / 1000000.0::DOUBLE AS ts, channel, value FROM samples")
def xdf_roundtrip_all(spark: SparkSession, sf: str) -> DataFrame:
    """All channels; as each has times of its own, each is a stream."""
    rows = tables.samples(spark, sf).select(F.concat_ws("/", "signal_id", "channel").alias("stream"), "seq", (signals.micros("ts") / 1e6).alias("ts"), "channel", "value")
    found = xdf.files(rows, 0.0).select("content").mapInPandas(lambda it: xdf.decode_all(c for b in it for c in b["content"]), xdf.SCHEMA).drop("text")
    return found.withColumn("stream", F.substring_index("stream", "/", 1))


@query("xdf_footer", f"WITH {_SAMPLES} SELECT signal_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS sample_count FROM samples GROUP BY signal_id")
def xdf_footer(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).groupBy("signal_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("sample_count"))


@query("replay_source", f"WITH {_SAMPLES} SELECT signal_id, channel, seq // 4 AS block, count(*) AS n FROM samples GROUP BY ALL")
def replay_source(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).groupBy("signal_id", "channel", F.floor(F.col("seq") / 4).alias("block")).agg(F.count("*").alias("n"))


@query("select_stream", f"WITH {_SAMPLES} SELECT * FROM samples WHERE channel = 'click'")
def select_stream(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).where("channel = 'click'")


@query("gen_signal", f"SELECT range % 100 AS seq, 'channel_' || range // 100 AS channel, 1 + 4 * (range % 100) / 99 AS ts, {generators.uniform_sql('range', 42)} AS value FROM range(3200)")
def gen_signal(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(3200).select((F.col("id") % 100).alias("seq"), F.concat(F.lit("channel_"), F.floor(F.col("id") / 100)).alias("channel"), (1 + 4 * (F.col("id") % 100) / 99).alias("ts"), generators.uniform("id", 42).alias("value"))


@query("gen_features", f"SELECT range // 40 AS row_id, CAST(range // 40 % 2 AS VARCHAR) AS class, range % 40 AS j, {generators.uniform_sql('range', 7)} + 0.5 * (range // 40 % 2) AS value FROM range(4000)")
def gen_features(spark: SparkSession, sf: str) -> DataFrame:
    return generators.class_features(spark, 100, 40, 2, 0.5, 7)


# ---- projections and filters -------------------------------------------------------------


@query("select_label", f"WITH {_WIDE} SELECT signal_id, seq, l_tax FROM wide")
def select_label(spark: SparkSession, sf: str) -> DataFrame:
    return signals.select_labels(tables.wide(spark, sf), ["l_tax"], tables.CHANNELS)


@query("select_labels", f"WITH {_WIDE} SELECT signal_id, seq, l_quantity, l_tax FROM wide")
def select_labels(spark: SparkSession, sf: str) -> DataFrame:
    return signals.select_labels(tables.wide(spark, sf), ["l_quantity", "l_tax"], tables.CHANNELS)


@query("select_label_range", f"WITH {_WIDE} SELECT signal_id, seq, l_quantity, l_extendedprice, l_discount FROM wide")
def select_label_range(spark: SparkSession, sf: str) -> DataFrame:
    return signals.select_labels(tables.wide(spark, sf), signals.label_range(tables.CHANNELS, "l_quantity", "l_discount"), tables.CHANNELS)


@query("select_channels", f"WITH {_SAMPLES} SELECT * FROM samples WHERE lower(channel) IN ('click', 'purchase')")
def select_channels(spark: SparkSession, sf: str) -> DataFrame:
    return signals.select_channels(tables.samples(spark, sf), ["Click", "PURCHASE"])


@query("select_rows", f"WITH {_WIDE} SELECT * FROM wide WHERE seq >= 5 AND seq < 15")
def select_rows(spark: SparkSession, sf: str) -> DataFrame:
    return signals.select_rows(tables.wide(spark, sf), 5, 15)


@query("step_slice", f"WITH {_WIDE} SELECT * FROM wide WHERE seq >= 2 AND seq < 400 AND (seq - 2) % 20 = 0")
def step_slice(spark: SparkSession, sf: str) -> DataFrame:
    return signals.select_rows(tables.wide(spark, sf), 2, 400, 20)


@query("cell", f"WITH {_WIDE} SELECT * FROM wide WHERE seq = 3")
def cell(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).where("seq = 3")


@query("mask_hull", f"WITH {_WIDE}, {_LONG}, m AS (SELECT *, (channel = 'l_quantity' AND value > 49) OR (channel = 'l_tax' AND value > 0.079) AS hit FROM long), h AS (SELECT signal_id, seq, class, channel, value, bool_or(hit) OVER (PARTITION BY signal_id, seq) AS r, bool_or(hit) OVER (PARTITION BY signal_id, channel) AS c FROM m) SELECT signal_id, seq, class, channel, value FROM h WHERE r AND c")
def mask_hull(spark: SparkSession, sf: str) -> DataFrame:
    hit = ((F.col("channel") == "l_quantity") & (F.col("value") > 49)) | ((F.col("channel") == "l_tax") & (F.col("value") > 0.079))
    return signals.mask_hull(tables.melt(tables.wide(spark, sf)), hit)


@query("filter_rows_by_col", f"WITH {_WIDE} SELECT * FROM wide WHERE l_discount > 0.05")
def filter_rows_by_col(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).where("l_discount > 0.05")


@query("filter_cols_by_row", f"WITH {_WIDE}, {_LONG} SELECT * FROM long SEMI JOIN (SELECT signal_id, channel FROM long WHERE seq = 1 AND value > 0.04) USING (signal_id, channel)")
def filter_cols_by_row(spark: SparkSession, sf: str) -> DataFrame:
    long = tables.melt(tables.wide(spark, sf))
    return long.join(long.where("seq = 1 and value > 0.04").select("signal_id", "channel"), ["signal_id", "channel"], "left_semi")


@query("compare", f"WITH {_WIDE} SELECT signal_id, seq, l_discount < l_tax AS lt, l_discount = l_tax AS eq, l_quantity >= 25 AS ge FROM wide")
def compare(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).selectExpr("signal_id", "seq", "l_discount < l_tax as lt", "l_discount = l_tax as eq", "l_quantity >= 25 as ge")


@query("add_sub", f"WITH {_WIDE} SELECT a.signal_id, a.seq, a.l_quantity + b.l_tax AS added, a.l_quantity - 1 AS less FROM wide a JOIN wide b USING (signal_id, seq)")
def add_sub(spark: SparkSession, sf: str) -> DataFrame:
    a = tables.wide(spark, sf)
    return a.select("signal_id", "seq", "l_quantity").join(a.select("signal_id", "seq", "l_tax"), ["signal_id", "seq"]).selectExpr("signal_id", "seq", "l_quantity + l_tax as added", "l_quantity - 1 as less")


@query("assign", f"WITH {_WIDE} SELECT signal_id, seq, CASE WHEN seq < 10 THEN 0 ELSE l_quantity END AS l_quantity FROM wide")
def assign(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).select("signal_id", "seq", F.when(F.col("seq") < 10, 0.0).otherwise(F.col("l_quantity")).alias("l_quantity"))


@query("select_class", f"WITH {_WIDE} SELECT * FROM wide WHERE class BETWEEN 'A' AND 'N'")
def select_class(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).where("class between 'A' and 'N'")


@query("class_count", f"WITH {_WIDE} SELECT class, count(*) AS n FROM wide WHERE seq % 20 = 0 GROUP BY class")
def class_count(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).where("seq % 20 = 0").groupBy("class").agg(F.count("*").alias("n"))


@query("class_count_all", f"WITH {_WIDE} SELECT class, count(*) AS n FROM wide GROUP BY class")
def class_count_all(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide(spark, sf).groupBy("class").agg(F.count("*").alias("n"))


@query("conf_filter", f"WITH {_SAMPLES} SELECT * FROM samples WHERE value >= 0.9")
def conf_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).where("value >= 0.9")


@query("class_selector", "SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS class FROM embeddings WHERE label < 4")
def class_selector(spark: SparkSession, sf: str) -> DataFrame:
    return tables.features(spark, sf).where(F.col("class").cast("int") < 4).select("row_id", "class")


@query("labels_duration", f"WITH {_SAMPLES} SELECT signal_id, count(DISTINCT channel) AS n_labels, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS duration_us FROM samples GROUP BY signal_id")
def labels_duration(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).groupBy("signal_id").agg(F.countDistinct("channel").alias("n_labels"), F.count("*").alias("n"), (signals.micros(F.max("ts")) - signals.micros(F.min("ts"))).alias("duration_us"))


@query("lowercase_labels", "SELECT o_orderkey, lower(o_orderpriority) AS label FROM orders")
def lowercase_labels(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("label"))


# ---- joins -------------------------------------------------------------------------------

_SEGMENT = f"WITH {_SAMPLES}, {_MARKERS}, {_BOUNDS} SELECT s.*, marker, marker_ts FROM samples s JOIN markers m USING (signal_id) JOIN bounds b USING (signal_id) WHERE s.ts >= marker_ts - INTERVAL 6 HOUR AND s.ts < marker_ts + INTERVAL 6 HOUR AND marker_ts - INTERVAL 6 HOUR >= first_ts AND marker_ts + INTERVAL 6 HOUR <= last_ts"


@query("segment", _SEGMENT)
def segment(spark: SparkSession, sf: str) -> DataFrame:
    return signals.segment(tables.samples(spark, sf), tables.markers(spark, sf), -_DAY / 4, _DAY / 4)


@query("find_index", f"WITH {_SAMPLES}, t AS (SELECT DISTINCT user_id AS signal_id, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 12 HOUR AS target_ts FROM events) SELECT signal_id, target_ts, ts, channel, seq, value FROM t JOIN samples s USING (signal_id) WHERE abs(epoch_us(ts) - epoch_us(target_ts)) <= 7200000000 QUALIFY row_number() OVER (PARTITION BY signal_id, target_ts ORDER BY abs(epoch_us(ts) - epoch_us(target_ts)), ts, channel, seq) = 1")
def find_index(spark: SparkSession, sf: str) -> DataFrame:
    noon = F.expr("date_trunc('DAY', ts) + interval 12 hours").cast("timestamp_ntz")
    targets = tables.table(spark, sf, "events").select(F.col("user_id").alias("signal_id"), noon.alias("target_ts")).distinct()
    return signals.nearest(tables.samples(spark, sf), targets, _DAY / 12)


@query("signal_align", f"WITH {_SAMPLES} SELECT signal_id, seq, a.value AS click, b.value AS purchase FROM (SELECT * FROM samples WHERE channel = 'click') a JOIN (SELECT * FROM samples WHERE channel = 'purchase') b USING (signal_id, seq)")
def signal_align(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.samples(spark, sf)
    side = lambda c: s.where(F.col("channel") == c).select("signal_id", "seq", F.col("value").alias(c))
    return side("click").join(side("purchase"), ["signal_id", "seq"])


@query("trials_collect", "SELECT 'left' AS class, l_orderkey AS trial_id, l_quantity AS value FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'right', l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def trials_collect(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.table(spark, sf, "lineitem")
    side = lambda flag, name: df.where(F.col("l_returnflag") == flag).select(F.lit(name).alias("class"), F.col("l_orderkey").alias("trial_id"), F.col("l_quantity").alias("value"))
    return side("A", "left").unionByName(side("R", "right"))


# ---- statistics --------------------------------------------------------------------------

_DERIVED = f"{_SAMPLES}, d1s AS (SELECT *, value - lag(value) OVER (PARTITION BY signal_id, channel ORDER BY seq) AS d1 FROM samples), d AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY signal_id, channel ORDER BY seq) AS d2 FROM d1s)"
_MOBILITY = "CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(d1) / stddev_samp(value) END"
_SQL = {
    "mean": "avg(value)", "var": "var_samp(value)", "std": "stddev_samp(value)", "ptp": "max(value) - min(value)",
    "skew": "CASE WHEN var_pop(value) > 0 THEN (avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5 END",
    "kurt": "CASE WHEN var_pop(value) > 0 THEN (avg(value ** 4) - 4 * avg(value) * avg(value ** 3) + 6 * avg(value) ** 2 * avg(value ** 2) - 3 * avg(value) ** 4) / var_pop(value) ** 2 - 3 END",
    "rms": "sqrt(avg(value * value))", "mobility": _MOBILITY,
    "complexity": f"CASE WHEN {_MOBILITY} > 0 THEN (CASE WHEN stddev_samp(d1) > 0 THEN stddev_samp(d2) / stddev_samp(d1) END) / ({_MOBILITY}) END",
    "q75": "quantile_cont(value, 0.75)", "q25": "quantile_cont(value, 0.25)",
}


def _stat(name: str) -> None:
    digits = 4 if name in ("skew", "kurt") else 6
    sql = f"WITH {_DERIVED} SELECT signal_id, channel, round({_SQL[name]}, {digits}) AS feature_{name} FROM d GROUP BY signal_id, channel"

    @query(f"stat_{name}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return statistics.summarize(tables.samples(spark, sf), (name,), digits=digits)


for _name in statistics.STATISTICS:
    _stat(_name)

_DIGITS = {"skew": 4, "kurt": 4}
_ALL = tuple(n for n in statistics.STATISTICS if n not in ("skew", "kurt"))


@query("stats_all_11", f"WITH {_DERIVED} SELECT signal_id, channel, {', '.join(f'round({_SQL[n]}, {_DIGITS.get(n, 6)}) AS feature_{n}' for n in statistics.STATISTICS)} FROM d GROUP BY signal_id, channel")
def stats_all_11(spark: SparkSession, sf: str) -> DataFrame:
    """All eleven statistics in one aggregation."""
    return statistics.summarize(tables.samples(spark, sf), digits=_DIGITS)


@query("stats_all", f"WITH {_DERIVED} SELECT signal_id, channel, {', '.join(f'round({_SQL[n]}, 6) AS feature_{n}' for n in _ALL)} FROM d GROUP BY signal_id, channel")
def stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.summarize(tables.samples(spark, sf), _ALL)


@query("stats_rollup", f"WITH {_SAMPLES} SELECT signal_id, channel, count(*) AS n, round(avg(value), 6) AS mean FROM samples GROUP BY ROLLUP (signal_id, channel)")
def stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).rollup("signal_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("log_var", f"WITH {_SAMPLES}, v AS (SELECT signal_id, channel, var_pop(value) AS v FROM samples GROUP BY ALL) SELECT signal_id, channel, round(ln(v / sum(v) OVER (PARTITION BY signal_id)), 6) AS log_var FROM v WHERE v > 0")
def log_var(spark: SparkSession, sf: str) -> DataFrame:
    v = tables.samples(spark, sf).groupBy("signal_id", "channel").agg(F.var_pop("value").alias("v")).where("v > 0")
    return v.select("signal_id", "channel", F.round(F.ln(F.col("v") / F.sum("v").over(Window.partitionBy("signal_id"))), 6).alias("log_var"))


_PAIRED = "p AS (SELECT a.signal_id, a.seq, a.channel AS a, b.channel AS b, a.value AS x, b.value AS y FROM samples a JOIN samples b ON a.signal_id = b.signal_id AND a.seq = b.seq AND a.channel {op} b.channel)"


def _paired(spark: SparkSession, sf: str, diagonal: bool) -> DataFrame:
    s = tables.samples(spark, sf)
    a = s.select("signal_id", "seq", F.col("channel").alias("a"), F.col("value").alias("x"))
    b = s.select("signal_id", "seq", F.col("channel").alias("b"), F.col("value").alias("y"))
    return a.join(b, ["signal_id", "seq"]).where("a <= b" if diagonal else "a < b")


@query("trial_cov", f"WITH {_SAMPLES}, {_PAIRED.format(op='<=')}, c AS (SELECT signal_id, a, b, covar_samp(x, y) AS c FROM p GROUP BY ALL HAVING count(*) > 1) SELECT a, b, round(avg(c), 4) AS cov FROM c GROUP BY a, b")
def trial_cov(spark: SparkSession, sf: str) -> DataFrame:
    c = _paired(spark, sf, True).groupBy("signal_id", "a", "b").agg(F.covar_samp("x", "y").alias("c"), F.count("*").alias("n")).where("n > 1")
    return c.groupBy("a", "b").agg(F.round(F.avg("c"), 4).alias("cov"))


@query("conn_corr", f"WITH {_SAMPLES}, {_PAIRED.format(op='<')} SELECT signal_id, a, b, round(corr(x, y), 6) AS r FROM p GROUP BY ALL HAVING count(*) > 2 AND var_pop(x) > 0 AND var_pop(y) > 0")
def conn_corr(spark: SparkSession, sf: str) -> DataFrame:
    g = _paired(spark, sf, False).groupBy("signal_id", "a", "b").agg(statistics.correlation("x", "y").alias("r"), F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return g.where("n > 2 and vx > 0 and vy > 0").select("signal_id", "a", "b", F.round("r", 6).alias("r"))


@query("effective_srate", f"WITH {_SAMPLES} SELECT signal_id, channel, round(count(*) * 1000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))), 9) AS srate FROM samples GROUP BY ALL HAVING max(ts) > min(ts)")
def effective_srate(spark: SparkSession, sf: str) -> DataFrame:
    g = tables.samples(spark, sf).groupBy("signal_id", "channel").agg(F.count("*").alias("n"), (signals.micros(F.max("ts")) - signals.micros(F.min("ts"))).alias("d"))
    return g.where("d > 0").select("signal_id", "channel", F.round(F.col("n") * 1000000.0 / F.col("d"), 9).alias("srate"))


# ---- windows -----------------------------------------------------------------------------


def _window_sql(length: float, step: float, margin: float = 0.0) -> str:
    size, hop, slack = int(length * 1e6), int(step * 1e6), int(margin * 1e6)
    return (
        f"WITH {_SAMPLES}, {_BOUNDS}, k AS (SELECT signal_id, first_ts, unnest(range(0, greatest(0, (epoch_us(last_ts) - epoch_us(first_ts) - {size} + {slack} + {hop}) // {hop})::BIGINT)) AS window_id FROM bounds), "
        f"r AS (SELECT s.*, window_id FROM samples s JOIN k USING (signal_id) WHERE epoch_us(ts) - epoch_us(first_ts) >= window_id * {hop} AND epoch_us(ts) - epoch_us(first_ts) < window_id * {hop} + {size}) "
        "SELECT signal_id, window_id, channel, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY ALL"
    )


def _windowed(name: str, length: float, step: float, margin: float = 0.0) -> None:
    @query(name, _window_sql(length, step, margin))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w = signals.windows(tables.samples(spark, sf), length, step, margin)
        return w.groupBy("signal_id", "window_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_windowed("window_tumbling", 2 * _DAY, 2 * _DAY)
_windowed("window_step", 5 * _DAY, 2 * _DAY)
_windowed("window_percent", 4 * _DAY, signals.percent_step(4 * _DAY, 0.75))
_windowed("window_tolerance", 5 * _DAY, 5 * _DAY, _DAY)


@query("lag_diff", f"WITH {_SAMPLES} SELECT signal_id, channel, seq, value - lag(value) OVER (PARTITION BY signal_id, channel ORDER BY seq) AS d1 FROM samples")
def lag_diff(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.derivatives(tables.samples(spark, sf), signals.SIGNAL).select("signal_id", "channel", "seq", "d1")


@query("frame_rows", f"WITH {_SAMPLES} SELECT signal_id, channel, seq, round(avg(value) OVER (PARTITION BY signal_id, channel ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing FROM samples")
def frame_rows(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(*signals.SIGNAL).orderBy("seq").rowsBetween(-4, 0)
    return tables.samples(spark, sf).select("signal_id", "channel", "seq", F.round(F.avg("value").over(w), 6).alias("trailing"))


# ---- filters -----------------------------------------------------------------------------

_TAPS = [0.1, 0.2, 0.4, 0.2, 0.1]


def _fir_sql(centre: int) -> str:
    shift = lambda k: f"lag(value, {k - centre})" if k >= centre else f"lead(value, {centre - k})"
    return f"WITH {_SAMPLES} SELECT signal_id, channel, seq, round({' + '.join(f'{h} * coalesce({shift(k)} OVER (PARTITION BY signal_id, channel ORDER BY seq), 0)' for k, h in enumerate(_TAPS))}, 6) AS value FROM samples"


@query("fir_forward", _fir_sql(0))
def fir_forward(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).select("signal_id", "channel", "seq", F.round(signals.fir_columns(_TAPS), 6).alias("value"))


@query("fir_zero_shift", _fir_sql(2))
def fir_zero_shift(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).select("signal_id", "channel", "seq", F.round(signals.fir_columns(_TAPS, 2), 6).alias("value"))


@query("reref_avg", f"WITH {_SAMPLES} SELECT signal_id, seq, ts, channel, round(value - avg(value) OVER (PARTITION BY signal_id, seq), 6) AS value FROM samples")
def reref_avg(spark: SparkSession, sf: str) -> DataFrame:
    return signals.reference_average(tables.samples(spark, sf)).withColumn("value", F.round("value", 6))


@query("reref_prep")
def reref_prep(spark: SparkSession, sf: str) -> DataFrame:
    return signals.reference_robust(tables.samples(spark, sf))[0]


@query("noisy_channels", f"WITH {_SAMPLES} SELECT signal_id, channel, bool_or(isnan(value) OR value IS NULL) AS has_nan, coalesce(stddev_pop(value), 0) < 1e-9 AS is_flat FROM samples GROUP BY ALL")
def noisy_channels(spark: SparkSession, sf: str) -> DataFrame:
    return signals.noisy_channels(tables.samples(spark, sf))


@query("to_mne", f"WITH {_SAMPLES} SELECT signal_id, channel, seq, seq / 256 AS ts, value FROM samples")
def to_mne(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).select("signal_id", "channel", "seq", (F.col("seq") / 256).alias("ts"), "value")


#: Samples of a block of a filtered channel, and of a window whose kernel's space or time grows faster than its length.
_BLOCK, _WINDOW = 16_384, 1024


def _blockwise(name: str, kernel: Callable[[np.ndarray], np.ndarray], overlap: int) -> None:
    """A filter that reaches ``overlap`` samples to each side, in blocks: the same result as over the whole channel."""

    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        framed = signals.frames(signals.blocks(tables.samples(spark, sf), _BLOCK, overlap), (*signals.SIGNAL, "block"))
        return signals.core(signals.transform(framed, kernel), _BLOCK, overlap).withColumn("value", F.round("value", 9))


def _windowed(samples: DataFrame) -> DataFrame:
    """One row for each channel and window of up to ``_WINDOW`` samples."""
    return signals.frames(signals.blocks(samples, _WINDOW).withColumnRenamed("block", "window_id"), (*signals.SIGNAL, "window_id"))


_HIGH = kernels.windowed_sinc(256, (1.0,), 101, stop=True)
_SINC = kernels.windowed_sinc(256, (1.0,), 101, stop=True, window="blackman")
_BAND = kernels.windowed_sinc(256, (8.0, 30.0), 41)
_blockwise("fir_zero", lambda x: kernels.fir(x, _BAND, "zero"), 40)
_blockwise("detrend_highpass", lambda x: kernels.fir(x, _HIGH, "zero_shift"), 50)
_blockwise("detrend_sinc", lambda x: kernels.fir(x, _SINC, "zero_shift"), 50)
_blockwise("detrend_local", lambda x: kernels.detrend_local(x, 8, 2), 8)


@query("notch")
def notch(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.samples(spark, sf)
    return signals.without_lines(s, s, 256.0, 50.0)


@query("line_noise")
def line_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Mains lines are fitted to the detrended signal and taken from the signal itself, so its trend stays."""
    s = tables.samples(spark, sf)
    return signals.without_lines(s, QUERIES["detrend_highpass"](spark, sf), 256.0, 50.0)


@query("resample")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    """In the frequency domain, which takes a whole channel at once; ``resample_polyphase`` has no such bound."""
    return signals.spread(signals.transform(signals.frames(tables.samples(spark, sf)), lambda x: kernels.resample(x, 3, 2))).withColumn("value", F.round("value", 9))


@query("fir_design")
def fir_design(spark: SparkSession, sf: str) -> DataFrame:
    taps = kernels.windowed_sinc(256, (8.0, 30.0), 100)
    return spark.createDataFrame([(i, round(float(h), 9)) for i, h in enumerate(taps)], "tap long, h double")


@query("fir_design_auto")
def fir_design_auto(spark: SparkSession, sf: str) -> DataFrame:
    """All four filter types, with the length that the transition width needs."""
    kinds = {"low": ((30.0,), False), "high": ((1.0,), True), "band": ((8.0, 30.0), False), "stop": ((48.0, 52.0), True)}
    rows = [(name, i, float(h)) for name, (cut, stop) in kinds.items() for i, h in enumerate(kernels.designed(256.0, cut, stop))]
    return spark.createDataFrame(rows, "kind string, tap long, h double")


@query("min_phase")
def min_phase(spark: SparkSession, sf: str) -> DataFrame:
    taps = kernels.minimum_phase(kernels.windowed_sinc(256, (30.0,), 101))
    return spark.createDataFrame([(i, float(h)) for i, h in enumerate(taps)], "tap long, h double")


@query("fir_overlap_add")
def fir_overlap_add(spark: SparkSession, sf: str) -> DataFrame:
    """The causal filter of ``fir_forward`` by FFT and overlapping blocks."""
    framed = signals.frames(signals.blocks(tables.samples(spark, sf), _BLOCK, len(_TAPS)), (*signals.SIGNAL, "block"))
    out = signals.core(signals.transform(framed, lambda x: kernels.fir(x, np.array(_TAPS), "forward", "overlap_add")), _BLOCK, len(_TAPS))
    return out.withColumn("value", F.round("value", 6))


@query("resample_polyphase")
def resample_polyphase(spark: SparkSession, sf: str) -> DataFrame:
    return signals.polyphase(tables.samples(spark, sf), kernels.windowed_sinc(3, (0.45,), 31), 3, 2).withColumn("value", F.round("value", 6))


@query("notch_fir")
def notch_fir(spark: SparkSession, sf: str) -> DataFrame:
    """Band-stops at the mains frequency and its harmonics, one after another."""
    taps = np.array([1.0])
    for f in (50.0, 100.0):
        taps = np.convolve(taps, kernels.windowed_sinc(256, (f - 1, f + 1), 51, stop=True))
    reach = len(taps)
    framed = signals.frames(signals.blocks(tables.samples(spark, sf), _BLOCK, reach), (*signals.SIGNAL, "block"))
    return signals.core(signals.transform(framed, lambda x: kernels.fir(x, taps, "zero_shift")), _BLOCK, reach).withColumn("value", F.round("value", 6))


# ---- spectra, entropies, connectivity ----------------------------------------------------


def _feature(name: str, kernel: Callable[[np.ndarray], np.ndarray], windowed: bool = False) -> None:
    """A query with one row for each number that the kernel makes of a channel, or of each window of it."""

    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        framed = (_windowed if windowed else signals.frames)(tables.samples(spark, sf))
        out = signals.spread(signals.transform(framed, kernel), seq="item")
        return out.withColumn("value", F.when(~F.isnan("value"), F.round("value", 6)))


_BANDS = ((0.5, 4), (4, 8), (8, 13), (13, 30), (30, 100))


def band_power(x: np.ndarray) -> np.ndarray:
    """Power of one array in each band; NaN for a band without a bin."""
    f, p = kernels.welch(x, 256.0)
    inside = [(f >= a) & (f < b) for a, b in _BANDS]
    return np.array([p[at].sum() if at.any() else np.nan for at in inside])


@query("band_power")
def band_powers(spark: SparkSession, sf: str) -> DataFrame:
    freq = np.fft.rfftfreq(256, 1 / 256.0)
    inside = np.array([(freq >= low) & (freq < high) for low, high in _BANDS], float)
    p = signals.spectrum(tables.samples(spark, sf), 256.0, pick=inside)
    return p.select(*signals.SIGNAL, F.col("bin").alias("item"), F.round("power", 6).alias("value"))


@query("psd_welch")
def psd_welch(spark: SparkSession, sf: str) -> DataFrame:
    return signals.spectrum(tables.samples(spark, sf), 256.0).select(*signals.SIGNAL, F.col("bin").alias("item"), F.round("power", 6).alias("value"))


@query("wavelet_energy")
def wavelet_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Haar, three levels; blocks of a power of two add up to the whole channel."""
    framed = signals.frames(signals.blocks(tables.samples(spark, sf), _BLOCK), (*signals.SIGNAL, "block"))
    each = signals.spread(signals.transform(framed, kernels.haar_energy), seq="item")
    return each.groupBy(*signals.SIGNAL, "item").agg(F.round(F.sum("value"), 9).alias("value"))


@query("wavelet_energy_db4")
def wavelet_energy_db4(spark: SparkSession, sf: str) -> DataFrame:
    """Daubechies wavelets of four vanishing moments, three levels, for each window."""
    framed = _windowed(tables.samples(spark, sf))
    return signals.spread(signals.transform(framed, lambda x: kernels.wavelet_energy(x, kernels.daubechies(4), 3)), seq="item")


_FREQS = np.array([16.0, 32.0, 64.0])
_feature("ent_app", kernels.approximate_entropy, windowed=True)
_feature("ent_sample", kernels.sample_entropy, windowed=True)
_feature("ent_svd", lambda x: np.round(kernels.svd_entropy(x), 4), windowed=True)
_feature("psd_multitaper", lambda x: kernels.multitaper(x, 256.0)[1], windowed=True)
_feature("tfr_morlet", lambda x: (np.abs(kernels.morlet(x, 256.0, _FREQS)) ** 2).mean(1), windowed=True)
_feature("tfr_multitaper", lambda x: np.mean([(np.abs(kernels.morlet(x * t, 256.0, _FREQS)) ** 2).mean(1) for t in kernels.slepians(len(x), 4.0 / 2, 3)], 0), windowed=True)
_feature("tfr_stockwell", lambda x: (np.abs(kernels.stockwell(x)) ** 2).mean(1), windowed=True)
_feature("stft", lambda x: (np.abs(kernels.stft(x)) ** 2).mean(1) if len(x) >= 4 else np.zeros(3), windowed=True)


def _coupled(name: str, kernel: Callable[[np.ndarray, np.ndarray], float]) -> None:
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = signals.couple(signals.pairs(_windowed(tables.samples(spark, sf)), by=("signal_id", "window_id")), kernel, "value")
        return out.withColumn("value", F.when(~F.isnan("value"), F.round("value", 6)))


def _cross(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs((np.fft.rfft(a - a.mean()) * np.conj(np.fft.rfft(b - b.mean()))).mean()))


def _cross_tapered(a: np.ndarray, b: np.ndarray) -> float:
    t = kernels.slepians(len(a), 2.0, 3)
    return float(np.abs((np.fft.rfft(t * (a - a.mean()), axis=1) * np.conj(np.fft.rfft(t * (b - b.mean()), axis=1))).mean()))


_coupled("conn_plv", lambda a, b: float(np.abs(np.exp(1j * (kernels.phase(a) - kernels.phase(b))).mean())))
_coupled("csd_fourier", _cross)
_coupled("csd_multitaper", _cross_tapered)
_coupled("csd_morlet", lambda a, b: float(np.abs((kernels.morlet(a, 256.0, _FREQS) * np.conj(kernels.morlet(b, 256.0, _FREQS))).mean())))


@query("conn_spec_corr")
def conn_spec_corr(spark: SparkSession, sf: str) -> DataFrame:
    p = signals.spectrum(tables.samples(spark, sf), 256.0)
    a, b = (p.select("signal_id", "bin", F.col("channel").alias(c), F.col("power").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    r = a.join(b, ["signal_id", "bin"]).where("a < b").groupBy("signal_id", "a", "b").agg(statistics.correlation("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return r.select("signal_id", "a", "b", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.round("r", 6)).alias("value"))


@query("ica_repair")
def ica_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Drops the component of the largest kurtosis from each supplier's channels; a rule in place of learned labels."""
    import pandas as pd

    channels = list(tables.CHANNELS)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq")
        x = t[channels].to_numpy(float).T
        if x.shape[1] > 10:
            mean, spread = x.mean(1, keepdims=True), x.std(1, keepdims=True) + 1e-12
            z = (x - mean) / spread
            w = kernels.fast_ica(z, len(channels))
            s = w @ z
            k = ((s - s.mean(1, keepdims=True)) ** 4).mean(1) / (s.var(1) ** 2 + 1e-12)
            s[int(k.argmax())] = 0
            x = np.linalg.pinv(w) @ s * spread + mean
        return pd.DataFrame({"signal_id": t["signal_id"], "seq": t["seq"], **dict(zip(channels, x))})

    return tables.wide(spark, sf).drop("class").groupBy("signal_id").applyInPandas(one, "signal_id long, seq long, " + ", ".join(f"{c} double" for c in channels))


# ---- order and sets ----------------------------------------------------------------------


@query("sort_markers", f"WITH {_MARKERS} SELECT signal_id, marker_ts, row_number() OVER (PARTITION BY signal_id ORDER BY marker_ts) AS place FROM markers")
def sort_markers(spark: SparkSession, sf: str) -> DataFrame:
    return tables.markers(spark, sf).select("signal_id", "marker_ts", F.row_number().over(Window.partitionBy("signal_id").orderBy("marker_ts")).cast("long").alias("place"))


_EMBEDDED = "f AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS class FROM embeddings)"


@query("sort_classes", f"WITH {_EMBEDDED}, n AS (SELECT class, count(*) AS n FROM f GROUP BY class) SELECT class, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop FROM n WINDOW w AS (ORDER BY class)")
def sort_classes(spark: SparkSession, sf: str) -> DataFrame:
    return models.class_ranges(tables.features(spark, sf))


@query("concat_rows", f"WITH {_WIDE}, u AS (SELECT 0 AS part, * FROM wide WHERE seq < 5 UNION ALL SELECT 1, * FROM wide WHERE seq >= 10 AND seq < 20) SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY part, seq) - 1 AS seq, class, l_quantity FROM u")
def concat_rows(spark: SparkSession, sf: str) -> DataFrame:
    w = tables.wide(spark, sf)
    u = signals.select_rows(w, 0, 5).withColumn("part", F.lit(0)).unionByName(signals.select_rows(w, 10, 20).withColumn("part", F.lit(1)))
    return u.select("signal_id", (F.row_number().over(Window.partitionBy("signal_id").orderBy("part", "seq")) - 1).cast("long").alias("seq"), "class", "l_quantity")


@query("concat_classes", f"WITH {_EMBEDDED} SELECT 0 AS part, row_id, class FROM f WHERE class < '3' UNION ALL SELECT 1, row_id, class FROM f WHERE class >= '2'")
def concat_classes(spark: SparkSession, sf: str) -> DataFrame:
    f = tables.features(spark, sf)
    return models.concat_classes(f.where("class < '3'"), f.where("class >= '2'")).drop("x")


@query("distinct_classes", f"WITH {_EMBEDDED} SELECT DISTINCT class FROM f")
def distinct_classes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.features(spark, sf).select("class").distinct()


@query("topk_features", "WITH s AS (SELECT vec_id // 4 AS band, vec_id % 4 AS j, embedding[1]::DOUBLE AS mi FROM embeddings), b AS (SELECT * FROM s ORDER BY mi DESC, band, j LIMIT 4) SELECT band, j FROM b UNION SELECT band, 3 - j FROM b")
def topk_features(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.features(spark, sf).select(F.floor(F.col("row_id") / 4).alias("band"), (F.col("row_id") % 4).alias("j"), F.col("x")[0].alias("mi"))
    return models.top_features(s, 4, 2)


# ---- features of trials, prediction, validation ------------------------------------------


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of two flags as trials of four channels, two bands of trailing means; a trial for each supplier and flag of more than 8 rows."""
    w = tables.trial_rows(spark, sf, ("A", "R"), 4).where("n > 8 and signal_id is not null")
    raw = F.array(*[F.col(c) * s for c, s in zip(tables.CHANNELS, (1.0, 1e-3, 100.0, 100.0))])
    bands = F.posexplode(F.array(raw, F.array(*[f"m_{c}" for c in tables.CHANNELS]))).alias("band", "x")
    return w.select((F.col("signal_id") * 2 + (F.col("class") == "R").cast("long")).alias("trial_id"), "class", "seq", bands).select("trial_id", "class", "band", "seq", "x")


@query("csp_cov_cells")
def csp_cov_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The mean covariances by cell."""
    return models.mean_covariances(_trials(spark, sf), len(tables.CHANNELS)).select("class", "band", F.posexplode("cov").alias("cell", "v")).select("class", "band", F.col("cell").cast("long").alias("cell"), F.round("v", 6).alias("cov"))


@query("csp_cov")
def csp_cov(spark: SparkSession, sf: str) -> DataFrame:
    return models.mean_covariances(_trials(spark, sf), len(tables.CHANNELS))


@query("fbcsp_extract")
def fbcsp_extract(spark: SparkSession, sf: str) -> DataFrame:
    cov = tables.stored(filterbank.raw_covariances(_trials(spark, sf), len(tables.CHANNELS)), "covariances")
    return models.FBCSP.fit_covariances(cov).transform_covariances(cov)


@query("fbcsp_json")
def fbcsp_json(spark: SparkSession, sf: str) -> DataFrame:
    cov = tables.stored(filterbank.raw_covariances(_trials(spark, sf), len(tables.CHANNELS)), "covariances")
    return models.FBCSP.from_json(models.FBCSP.fit_covariances(cov).to_json()).transform_covariances(cov)


def _classified(name: str, kind: str, rbf: bool = False) -> None:
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = tables.features(spark, sf)
        f = models.random_fourier(f) if rbf else f
        return models.predict(models.fit(kind, f.where(models.held_out() > 0)), f)


_classified("clf_logreg", "logreg")
_classified("clf_svm", "svm")
_classified("clf_svm_rbf", "svm", rbf=True)
_classified("clf_rf", "rf")


@query("clf_lda")
def clf_lda(spark: SparkSession, sf: str) -> DataFrame:
    f = tables.features(spark, sf)
    return models.Discriminant.fit(f.where(models.held_out() > 0)).predict(f)


_FEATURED = "f AS MATERIALIZED (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS class, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL)"


@query("lda_means", f"WITH {_FEATURED} SELECT class, i, round(avg(x), 6) + 0.0::DOUBLE AS mean FROM f GROUP BY class, i")
def lda_means(spark: SparkSession, sf: str) -> DataFrame:
    """Class means of the discriminant of all rows."""
    model = models.Discriminant.fit(tables.features(spark, sf))
    return spark.createDataFrame([(c, i, round(float(v), 6) + 0.0) for c, row in zip(model.classes, model.means) for i, v in enumerate(row)], "class string, i long, mean double")


@query(
    "lda_pooled",
    f"WITH {_FEATURED}, d AS MATERIALIZED (SELECT row_id, class, i, x - avg(x) OVER (PARTITION BY class, i) AS x FROM f) "
    "SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x) / (count(*) - count(DISTINCT a.class)), 6) + 0.0::DOUBLE AS cov FROM d a JOIN d b USING (row_id) GROUP BY a.i, b.i",
)
def lda_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """The pooled covariance of the discriminant of all rows."""
    model = models.Discriminant.fit(tables.features(spark, sf))
    return spark.createDataFrame([(i, j, round(float(v), 6) + 0.0) for i, row in enumerate(model.pooled) for j, v in enumerate(row)], "i long, j long, cov double")


@query("predict_proba")
def predict_proba(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    f = tables.features(spark, sf)
    model = models.fit("logreg", f.where(models.held_out() > 0))
    out = model.transform(f.withColumn("features", models.array_to_vector("x")))
    p = vector_to_array("probability")
    return out.select("row_id", *[p[i].alias(f"p_{c}") for i, c in enumerate(model.stages[0].labels)])


_GUESS = "g AS (SELECT doc_id AS row_id, CAST(quality AS VARCHAR) AS class, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS prediction FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


def _guess(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents", "doc_id", "n_chars").join(tables.table(spark, sf, "labels"), "doc_id").where("quality is not null")
    return d.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("class"), F.when(F.col("n_chars") > 1500, "1").otherwise("0").alias("prediction"))


@query("confusion", f"WITH {_GUESS} SELECT class, prediction, count(*) AS n FROM g GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return models.confusion(_guess(spark, sf))


@query("metrics", f"WITH {_GUESS}, a AS (SELECT class, count(*) AS actual, count(*) FILTER (class = prediction) AS hit FROM g GROUP BY class), p AS (SELECT prediction AS class, count(*) AS guessed FROM g GROUP BY prediction) SELECT class, coalesce(hit / guessed, 0) AS precision, hit / actual AS recall, coalesce(2 * (hit / guessed) * (hit / actual) / nullif(hit / guessed + hit / actual, 0), 0) AS f1, (SELECT sum(hit) / sum(actual) FROM a) AS accuracy FROM a LEFT JOIN p USING (class)")
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return models.metrics(_guess(spark, sf))


@query("train_test_split", f"WITH {_EMBEDDED} SELECT row_id, class, row_id % 5 = 0 AS held_out FROM f")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return tables.features(spark, sf).select("row_id", "class", (F.col("row_id") % 5 == 0).alias("held_out"))


@query("cross_validate")
def cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    return models.cross_validate("logreg", tables.features(spark, sf), max_iter=10)


@query("cv_mean", f"WITH {_GUESS} SELECT round(avg(score), 9) AS mean_score FROM (SELECT row_id % 3 AS fold, avg((class = prediction)::INT) AS score FROM g GROUP BY ALL)")
def cv_mean(spark: SparkSession, sf: str) -> DataFrame:
    scores = _guess(spark, sf).groupBy((F.col("row_id") % 3).alias("fold")).agg(F.avg((F.col("class") == F.col("prediction")).cast("int")).alias("score"))
    return scores.agg(F.round(F.avg("score"), 9).alias("mean_score"))


# ---- streaming ---------------------------------------------------------------------------


@query("segment_online", f"WITH {_SAMPLES}, {_MARKERS} SELECT signal_id, ts, channel, value, marker_ts FROM samples JOIN markers USING (signal_id) WHERE ts >= marker_ts - INTERVAL 6 HOUR AND ts < marker_ts + INTERVAL 6 HOUR")
def segment_online(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet*"
    m = online.stream(spark, path).where("channel = 'purchase'").select("signal_id", F.col("ts").alias("marker_ts"))
    out = online.drained(online.segment(online.stream(spark, path), m, -_DAY / 4, _DAY / 4).drop("seq"), "segments")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "marker_ts")})


_STREAM = "e AS (SELECT user_id AS signal_id, event_id AS seq, ts, event_type AS channel, value FROM events)"


def _windows_online(spark: SparkSession, sf: str, length: str, step: str | None = None) -> DataFrame:
    """Each window once, when the watermark has passed it and its state is dropped."""
    stream, late = keyed.replay(spark, sf, 4 * _DAY)
    return online.drained(online.tumbling(stream, length, step, late), "windows").where(F.col("signal_id") != stateful.CLOCK)


def _sessions_online(spark: SparkSession, sf: str) -> DataFrame:
    stream, late = keyed.replay(spark, sf)
    return online.drained(online.sessions(stream, "6 hours", late), "sessions").where(F.col("signal_id") != stateful.CLOCK)


@query("window_online")
def window_online(spark: SparkSession, sf: str) -> DataFrame:
    return _windows_online(spark, sf, "2 days")


@query("session_online")
def session_online(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions_online(spark, sf)


@query("window_spans_online", f"WITH {_STREAM} SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 2 DAY AS stop, signal_id, channel, count(*) AS n, round(avg(value), 6) AS feature_mean FROM e GROUP BY ALL")
def window_spans_online(spark: SparkSession, sf: str) -> DataFrame:
    """``window_online`` with start and end as columns."""
    out = _windows_online(spark, sf, "2 days")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("stop"), "signal_id", "channel", "n", F.round("feature_mean", 6).alias("feature_mean"))


@query("window_step_online", f"WITH {_STREAM}, w AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(k::INT) AS start FROM e, (SELECT unnest(range(3)) AS k)) SELECT start, signal_id, channel, count(*) AS n, round(avg(value), 6) AS feature_mean FROM w GROUP BY ALL")
def window_step_online(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three days, a new one each day."""
    out = _windows_online(spark, sf, "3 days", "1 day")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "signal_id", "channel", "n", F.round("feature_mean", 6).alias("feature_mean"))


@query("session_spans_online", f"WITH {_STREAM}, g AS (SELECT *, sum(new) OVER (PARTITION BY signal_id ORDER BY ts, seq) AS k FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY signal_id ORDER BY ts, seq) > INTERVAL 6 HOUR, true))::INT AS new FROM e)) SELECT signal_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM g GROUP BY signal_id, k")
def session_spans_online(spark: SparkSession, sf: str) -> DataFrame:
    """``session_online`` with start and end as columns."""
    out = _sessions_online(spark, sf)
    return out.select("signal_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), "n")


_ONLINE_FIR = " + ".join(f"{h} * coalesce(lag(value, {k}) OVER (PARTITION BY signal_id, channel ORDER BY seq), 0)" for k, h in enumerate(_TAPS))


@query("fir_online", f"WITH {_STREAM} SELECT signal_id, channel, seq, round({_ONLINE_FIR}, 6) AS value FROM e")
def fir_online(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample when the ten days it belongs to are complete; a few inputs are all that the state carries on."""
    return keyed.through(spark, sf, stateful.Fir(_TAPS, 10 * _DAY, 1e9)).withColumn("value", F.round("value", 6))


@query("ring_buffer", f"WITH {_STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, channel ORDER BY seq DESC) AS back FROM e) SELECT signal_id, channel, count(*)::INT AS n, min(seq) AS first_seq, max(seq) AS last_seq, round(avg(value), 6) AS mean FROM r WHERE back <= 8 GROUP BY ALL")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """The last eight samples of each channel as its last complete ten days leave them in the state of a stream."""
    found = keyed.through(spark, sf, stateful.Ring(8, 10 * _DAY, 1e9))
    last = found.groupBy("signal_id", "channel").agg(F.max_by(F.struct("n", "first_seq", "last_seq", "mean"), "bucket").alias("r")).select("signal_id", "channel", "r.*")
    return last.withColumn("mean", F.round("mean", 6))


@query("segment_at", f"WITH {_STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY ts DESC, seq DESC) AS back FROM e), b AS (SELECT signal_id, min(ts) AS low, max(ts) AS high, make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS pivot_ts FROM r WHERE back <= 40 GROUP BY signal_id) SELECT signal_id, pivot_ts, ts, channel, seq, value FROM r JOIN b USING (signal_id) WHERE back <= 40 AND pivot_ts - INTERVAL 1 DAY >= low AND pivot_ts + INTERVAL 1 DAY <= high AND ts >= pivot_ts - INTERVAL 1 DAY AND ts < pivot_ts + INTERVAL 1 DAY")
def segment_at(spark: SparkSession, sf: str) -> DataFrame:
    """Of the last 40 samples of each signal those a day around their middle; none where an edge lies outside."""
    e = tables.table(spark, sf, "events").select(F.col("user_id").alias("signal_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("channel"), "value")
    last = signals.last_rows(e, 40, ("signal_id",), ("ts", "seq"))
    pivots = signals.bounds(last).select("signal_id", F.timestamp_micros(F.floor((signals.micros("first_ts") + signals.micros("last_ts")) / 2)).cast("timestamp_ntz").alias("pivot_ts"))
    return signals.segment_at(last, pivots, -_DAY, _DAY)



from tidewave.plans import banks, coherence, filters, keyed, prediction, recordings, spectra  # noqa: E402, F401  (they add their queries and SQL)
