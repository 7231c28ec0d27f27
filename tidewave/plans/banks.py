"""Queries of the filter bank and of common spatial patterns on its bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import filterbank, models
from tidewave.plans.registry import query
from tidewave.sources import tables

BANK = filterbank.Bank.spaced(128.0, length=33)
_SCALES = (1.0, 1e-3, 100.0, 100.0)


def trials(spark: SparkSession, sf: str, least_rows: int = 2) -> DataFrame:
    """(trial_id, class, seq, x): the line items of two flags, a trial for each supplier and flag of at least ``least_rows`` rows."""
    rows = tables.trial_rows(spark, sf, ("A", "R")).where(F.col("n") >= least_rows)
    x = F.array(*[F.col(c) * s for c, s in zip(tables.CHANNELS, _SCALES)])
    return rows.select((F.col("signal_id") * 2 + (F.col("class") == "R").cast("long")).alias("trial_id"), "class", "seq", x.alias("x"))


_x = ", ".join(f"l_{c} * {s} AS x{i}" for i, (c, s) in enumerate(zip(("quantity", "extendedprice", "discount", "tax"), _SCALES)))
_taps = ", ".join(f"({band}, {k}, {float(h)!r})" for band, row in enumerate(BANK.taps()) for k, h in enumerate(row))
_BANKED = f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem),
t AS (SELECT l_suppkey * 2 + (l_returnflag = 'R')::INT AS trial_id, l_returnflag AS class, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY pos) - 1 AS seq, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n, {_x} FROM w WHERE l_returnflag IN ('A', 'R')),
taps(band, k, h) AS (VALUES {_taps}),
banked AS (SELECT trial_id, t.class, band, t.seq, {", ".join(f"sum(h * s.x{i}) AS x{i}" for i in range(4))} FROM t JOIN taps ON true JOIN t s USING (trial_id) WHERE s.seq = t.seq + {BANK.reach} - k AND t.n > 1 GROUP BY ALL)
"""
_cells = " UNION ALL ".join(f"SELECT trial_id, class, band, {4 * a + b} AS cell, covar_samp(x{a}, x{b}) AS v FROM banked GROUP BY ALL" for a in range(4) for b in range(4))


@query("filter_bank", f"{_BANKED} SELECT trial_id, class, band, seq, {', '.join(f'round(x{i}, 4) + 0.0::DOUBLE AS x{i}' for i in range(4))} FROM banked")
def filter_bank(spark: SparkSession, sf: str) -> DataFrame:
    """All trials through nine bands from 4 to 40 Hz."""
    out = filterbank.filtered(trials(spark, sf), BANK, digits=4)
    return out.select("trial_id", "class", "band", "seq", *[(F.col("x")[i] + 0.0).alias(f"x{i}") for i in range(4)])


@query("fbcsp_bank_cov", f"{_BANKED}, c AS ({_cells}) SELECT class, band, cell, round(avg(v), 6) AS cov FROM c GROUP BY ALL")
def fbcsp_bank_cov(spark: SparkSession, sf: str) -> DataFrame:
    """Mean channel covariances of each class and band, by cell."""
    mean = models.averaged(filterbank.covariances(trials(spark, sf), BANK, channels=len(tables.CHANNELS)))
    return mean.select("class", "band", F.posexplode("cov").alias("cell", "v")).select("class", "band", F.col("cell").cast("long").alias("cell"), F.round("v", 6).alias("cov"))


@query("fbcsp_bank")
def fbcsp_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Selected features of all trials; each trial is filtered once, all further steps read its covariances."""
    cov = tables.stored(filterbank.covariances(trials(spark, sf), BANK, channels=len(tables.CHANNELS)), "covariances")
    return models.FBCSP.fit_covariances(cov).transform_covariances(cov)
