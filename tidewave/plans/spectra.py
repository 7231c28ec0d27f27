"""SQL for DuckDB that checks the queries of kernels: transforms written out as sums of sines and cosines."""

from __future__ import annotations

import math

from tidewave.functions import kernels
from tidewave.plans import catalog
from tidewave.plans.registry import ORACLES

_S = "samples AS MATERIALIZED (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq, ts, event_type AS channel, value FROM events)"
_W = f"{_S}, w AS MATERIALIZED (SELECT signal_id, channel, seq // 1024 AS window_id, seq % 1024 AS i, value AS x FROM samples), n AS (SELECT signal_id, channel, window_id, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM w GROUP BY ALL)"
_KEY = "signal_id, channel, window_id"
_OVER = f"OVER (PARTITION BY {_KEY} ORDER BY i)"

# ---- entropies ---------------------------------------------------------------------------

_EMBEDDED = f"{_W}, e AS MATERIALIZED (SELECT {_KEY}, i, x, lead(x) {_OVER} AS y, lead(x, 2) {_OVER} AS z FROM w)"
_NEAR = "FROM e a JOIN e b USING (signal_id, channel, window_id) JOIN n USING (signal_id, channel, window_id) WHERE abs(a.x - b.x) <= 0.2 * sd AND abs(a.y - b.y) <= 0.2 * sd"
ORACLES["ent_sample"] = (
    f"WITH {_EMBEDDED}, m AS (SELECT {_KEY}, count(*) AS b, count(*) FILTER (abs(a.z - b.z) <= 0.2 * sd) AS a {_NEAR} AND a.z IS NOT NULL AND b.z IS NOT NULL AND a.i <> b.i GROUP BY ALL) "
    f"SELECT {_KEY}, 0 AS item, CASE WHEN n >= 4 AND a > 0 AND b > 0 THEN round(ln(b / a), 6) END AS value FROM n LEFT JOIN m USING ({_KEY})"
)
ORACLES["ent_app"] = (
    f"WITH {_EMBEDDED}, c2 AS (SELECT {_KEY}, a.i AS i, count(*) / (any_value(n) - 1) AS c {_NEAR} GROUP BY ALL), c3 AS (SELECT {_KEY}, a.i AS i, count(*) / (any_value(n) - 2) AS c {_NEAR} AND abs(a.z - b.z) <= 0.2 * sd GROUP BY ALL), "
    f"p2 AS (SELECT {_KEY}, avg(ln(c)) AS p FROM c2 GROUP BY ALL), p3 AS (SELECT {_KEY}, avg(ln(c)) AS q FROM c3 GROUP BY ALL) "
    f"SELECT {_KEY}, 0 AS item, CASE WHEN n >= 4 THEN round(p - q, 6) END AS value FROM n LEFT JOIN p2 USING ({_KEY}) LEFT JOIN p3 USING ({_KEY})"
)
# singular values of the delay embedding are roots of the eigenvalues of a 3 x 3 matrix
ORACLES["ent_svd"] = (
    f"WITH {_W}, e AS (SELECT {_KEY}, x, lead(x, 2) {_OVER} AS y, lead(x, 4) {_OVER} AS z FROM w), g AS (SELECT {_KEY}, sum(x * x) AS a, sum(y * y) AS b, sum(z * z) AS c, sum(x * y) AS d, sum(x * z) AS e, sum(y * z) AS f FROM e WHERE z IS NOT NULL GROUP BY ALL), "
    "q AS (SELECT *, (a + b + c) / 3 AS q, d * d + e * e + f * f AS off FROM g), p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * off) / 6) AS p FROM q), "
    "r AS (SELECT *, greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3))) AS r FROM p), "
    f"l AS (SELECT *, q + 2 * p * cos(acos(r) / 3) AS l1, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l3 FROM r), v AS (SELECT *, [sqrt(greatest(l1, 0)), sqrt(greatest(3 * q - l1 - l3, 0)), sqrt(greatest(l3, 0))] AS s FROM l) "
    f"SELECT {_KEY}, 0 AS item, CASE WHEN n >= 6 THEN round(-list_sum(list_transform(list_filter(s, lambda t: t > 0), lambda t: t / list_sum(s) * log2(t / list_sum(s)))), 4) END AS value FROM n LEFT JOIN v USING ({_KEY})"
)

# ---- wavelets and short spectra ----------------------------------------------------------

_levels = []
for _k in (1, 2, 3):
    _from = "samples" if _k == 1 else f"a{_k - 1}"
    _levels.append(f"p{_k} AS (SELECT signal_id, channel, seq // 2 AS seq, max(value) FILTER (seq % 2 = 0) AS x, max(value) FILTER (seq % 2 = 1) AS y FROM {_from} GROUP BY signal_id, channel, seq // 2 HAVING count(*) = 2)")
    _levels.append(f"a{_k} AS (SELECT signal_id, channel, seq, (x + y) / sqrt(2) AS value FROM p{_k})")
ORACLES["wavelet_energy"] = (
    f"WITH {_S}, {', '.join(_levels)}, d AS ({' UNION ALL '.join(f'SELECT signal_id, channel, {k - 1} AS item, sum((x - y) ** 2 / 2) AS value FROM p{k} GROUP BY ALL' for k in (1, 2, 3))}) "
    "SELECT signal_id, channel, item, round(coalesce(value, 0), 9) AS value FROM (SELECT DISTINCT signal_id, channel, k AS item FROM samples, (SELECT unnest(range(3)) AS k)) LEFT JOIN d USING (signal_id, channel, item)"
)
_sine = [math.sin(math.pi * (j + 0.5) / 4) for j in range(4)]
ORACLES["stft"] = (
    f"WITH {_W}, f AS (SELECT {_KEY}, i, x * {_sine[0]!r} AS a, lead(x) {_OVER} * {_sine[1]!r} AS b, lead(x, 2) {_OVER} * {_sine[2]!r} AS c, lead(x, 3) {_OVER} * {_sine[3]!r} AS d FROM w), "
    f"p AS (SELECT {_KEY}, [avg((a + b + c + d) ** 2), avg((a - c) ** 2 + (b - d) ** 2), avg((a - b + c - d) ** 2)] AS p FROM f WHERE d IS NOT NULL AND i % 2 = 0 GROUP BY ALL) "
    f"SELECT {_KEY}, item, round(coalesce(p[item + 1], 0), 6) AS value FROM (SELECT {_KEY}, unnest(range(3)) AS item FROM n) LEFT JOIN p USING ({_KEY})"
)

# ---- spectral densities ------------------------------------------------------------------

_WELCH = (
    f"{_S}, c AS (SELECT signal_id, channel, count(*) AS n FROM samples GROUP BY ALL), g AS (SELECT signal_id, channel, seq // 256 AS seg, seq % 256 AS j, value AS x, least(n, 256) AS own, n FROM samples JOIN c USING (signal_id, channel) WHERE n < 256 OR seq < n // 256 * 256), "
    "h AS MATERIALIZED (SELECT *, (x - avg(x) OVER (PARTITION BY signal_id, channel, seg)) * h AS y, h FROM (SELECT *, CASE WHEN own > 1 THEN 0.54 - 0.46 * cos(2 * pi() * j / (own - 1)) ELSE 1 END AS h FROM g)), "
    "d AS (SELECT signal_id, channel, seg, bin, sum(y * cos(2 * pi() * bin * j / 256)) AS re, sum(y * sin(2 * pi() * bin * j / 256)) AS im, sum(h * h) AS h2 FROM h, (SELECT unnest(range(129)) AS bin) GROUP BY ALL), "
    "s AS (SELECT signal_id, channel, bin, avg((re * re + im * im) / (256.0 * h2) * CASE WHEN bin IN (0, 128) THEN 1 ELSE 2 END) AS power FROM d GROUP BY ALL)"
)
ORACLES["psd_welch"] = f"WITH {_WELCH} SELECT signal_id, channel, bin AS item, round(power, 6) AS value FROM s"
_band = " ".join(f"WHEN bin >= {a} AND bin < {b} THEN {i}" for i, (a, b) in enumerate(catalog._BANDS))
ORACLES["band_power"] = f"WITH {_WELCH}, b AS (SELECT *, CASE {_band} END AS item FROM s) SELECT signal_id, channel, item, round(sum(power), 6) AS value FROM b WHERE item IS NOT NULL GROUP BY ALL"
ORACLES["conn_spec_corr"] = f"WITH {_WELCH} SELECT a.signal_id, a.channel AS a, b.channel AS b, CASE WHEN var_pop(a.power) > 0 AND var_pop(b.power) > 0 THEN round(corr(a.power, b.power), 6) END AS value FROM s a JOIN s b ON a.signal_id = b.signal_id AND a.bin = b.bin AND a.channel < b.channel GROUP BY ALL"

_waves = []
for _f in map(float, catalog._FREQS):
    _sigma = 7.0 / (2 * math.pi * _f)
    _n = math.ceil((6 * _sigma + 0.5 / 256) * 256)
    _t = [-3 * _sigma + k / 256 for k in range(_n)]
    _norm = math.sqrt(sum(math.exp(-t * t / _sigma**2) for t in _t))
    _waves.append((_f, _sigma, _n, _norm))
_WAVES = "v AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {q} AS item, k, {n} AS size, exp(-t * t / (2 * {s!r} * {s!r})) * cos(2 * pi() * {f!r} * t) / {m!r} AS re, exp(-t * t / (2 * {s!r} * {s!r})) * sin(2 * pi() * {f!r} * t) / {m!r} AS im FROM (SELECT k, -3 * {s!r} + k / 256 AS t FROM (SELECT unnest(range({n})) AS k))" for q, (f, s, n, m) in enumerate(_waves)) + ")"


def _convolved(source: str, keys: str) -> str:
    """Coefficients (re, im) of each frequency at each place i, from (keys, i, x)."""
    return f"SELECT {keys}, item, o.i AS i, sum(s.x * re) AS re, sum(s.x * im) AS im FROM {source} o JOIN {source} s USING ({keys}) JOIN v ON v.k = o.i + (v.size - 1) // 2 - s.i GROUP BY {keys}, item, o.i"


ORACLES["tfr_morlet"] = f"WITH {_W}, {_WAVES}, c AS ({_convolved('w', _KEY)}), p AS (SELECT {_KEY}, item, sum(re * re + im * im) AS p FROM c GROUP BY ALL) SELECT {_KEY}, q AS item, round(coalesce(p, 0) / n, 6) AS value FROM (SELECT *, unnest(range(3)) AS q FROM n) LEFT JOIN p USING ({_KEY}) WHERE item = q OR item IS NULL"
ORACLES["tfr_stockwell"] = (
    f"WITH {_W}, d AS MATERIALIZED (SELECT {_KEY}, k, any_value(n) AS n, sum(x * cos(2 * pi() * k * i / n)) AS re, sum(x * sin(2 * pi() * k * i / n)) AS im FROM w JOIN n USING ({_KEY}), (SELECT unnest(range(1024)) AS k) WHERE k < n GROUP BY ALL), "
    f"p AS MATERIALIZED (SELECT {_KEY}, n, k, re * re + im * im AS p FROM d), f AS (SELECT {_KEY}, n, unnest(range(1, n // 2 + 1)) AS item FROM n), "
    f"r AS (SELECT {_KEY}, item, sum(p * exp(-4 * pi() * pi() * g * g / (item * item))) / (any_value(n) * any_value(n)) AS value FROM (SELECT {_KEY}, f.n, item, p, ((k - item) % f.n + f.n) % f.n AS o, CASE WHEN o >= (f.n + 1) // 2 THEN o - f.n ELSE o END AS g FROM f JOIN p USING ({_KEY})) GROUP BY {_KEY}, item) "
    f"SELECT {_KEY}, 0 AS item, round(mean * mean, 6) AS value FROM n UNION ALL SELECT {_KEY}, item, round(value, 6) FROM r"
)

# ---- couplings ---------------------------------------------------------------------------

_PAIR = "signal_id, window_id, a, b"
_PAIRS = (
    f"{_W}, k AS (SELECT a.signal_id, a.window_id, a.channel AS a, b.channel AS b, least(a.n, b.n) AS n FROM n a JOIN n b ON a.signal_id = b.signal_id AND a.window_id = b.window_id AND a.channel < b.channel), "
    "u AS MATERIALIZED (SELECT k.*, side, i, x FROM (SELECT *, unnest(['a', 'b']) AS side FROM k) k JOIN w ON w.signal_id = k.signal_id AND w.window_id = k.window_id AND w.channel = CASE WHEN side = 'a' THEN a ELSE b END AND i < n WHERE n > 1), "
    f"z AS MATERIALIZED (SELECT *, x - avg(x) OVER (PARTITION BY {_PAIR}, side) AS y FROM u)"
)
_BOTH = f"JOIN (SELECT * FROM {{0}} WHERE side = 'b') r ON l.signal_id = r.signal_id AND l.window_id = r.window_id AND l.a = r.a AND l.b = r.b AND l.{{1}} = r.{{1}} WHERE l.side = 'a'"
_DFT = f"d AS MATERIALIZED (SELECT {_PAIR}, side, f, any_value(n) AS n, sum(y * cos(2 * pi() * f * i / n)) AS re, -sum(y * sin(2 * pi() * f * i / n)) AS im FROM z, (SELECT unnest(range(1024)) AS f) WHERE f {{0}} GROUP BY ALL)"
_ALL_PAIRS = f"SELECT {_PAIR}, round(value, 6) AS value FROM k LEFT JOIN o USING ({_PAIR})"
ORACLES["csd_fourier"] = (
    f"WITH {_PAIRS}, {_DFT.format('<= n // 2')}, o AS (SELECT l.signal_id, l.window_id, l.a, l.b, sqrt(avg(l.re * r.re + l.im * r.im) ** 2 + avg(l.im * r.re - l.re * r.im) ** 2) AS value FROM d l {_BOTH.format('d', 'f')} GROUP BY ALL) {_ALL_PAIRS}"
)
ORACLES["conn_plv"] = (
    f"WITH {_PAIRS}, {_DFT.format('< n')}, g AS (SELECT *, CASE WHEN f = 0 OR (n % 2 = 0 AND f = n // 2) THEN 1 WHEN f < (n + 1) // 2 THEN 2 ELSE 0 END AS gain FROM d), "
    f"h AS MATERIALIZED (SELECT z.signal_id, z.window_id, z.a, z.b, z.side, z.i, sum(gain * (re * cos(2 * pi() * f * i / g.n) - im * sin(2 * pi() * f * i / g.n))) AS re, sum(gain * (re * sin(2 * pi() * f * i / g.n) + im * cos(2 * pi() * f * i / g.n))) AS im FROM z JOIN g USING ({_PAIR}, side) WHERE gain > 0 GROUP BY ALL), "
    f"q AS MATERIALIZED (SELECT *, atan2(im, re) AS p FROM h), o AS (SELECT l.signal_id, l.window_id, l.a, l.b, sqrt(avg(cos(l.p - r.p)) ** 2 + avg(sin(l.p - r.p)) ** 2) AS value FROM q l {_BOTH.format('q', 'i')} GROUP BY ALL) {_ALL_PAIRS}"
)
ORACLES["csd_morlet"] = (
    f"WITH {_PAIRS}, {_WAVES}, c AS MATERIALIZED ({_convolved('u', _PAIR + ', side')}), m AS (SELECT *, i * 3 + item AS place FROM c), "
    f"o AS (SELECT l.signal_id, l.window_id, l.a, l.b, sqrt(sum(l.re * r.re + l.im * r.im) ** 2 + sum(l.im * r.re - l.re * r.im) ** 2) AS total FROM m l {_BOTH.format('m', 'place')} GROUP BY ALL) "
    f"SELECT {_PAIR}, round(total / (3 * n), 6) AS value FROM k LEFT JOIN o USING ({_PAIR})"
)

# ---- filters -----------------------------------------------------------------------------


def _fir(taps: list[float], centre: int, column: str = "value") -> str:
    """A filter as a sum over lags."""
    over = "OVER (PARTITION BY signal_id, channel ORDER BY seq)"
    return " + ".join(f"{float(h)!r} * coalesce({f'lag({column}, {k - centre})' if k >= centre else f'lead({column}, {centre - k})'} {over}, 0)" for k, h in enumerate(taps))


_forward, _backward = list(catalog._BAND), list(catalog._BAND[::-1])
ORACLES["fir_zero"] = f"WITH {_S}, o AS (SELECT signal_id, channel, seq, {_fir(_forward, 20)} AS value FROM samples) SELECT signal_id, channel, seq, round({_fir(_backward, 20)}, 9) AS value FROM o"
ORACLES["detrend_highpass"] = f"WITH {_S} SELECT signal_id, channel, seq, round({_fir(list(catalog._HIGH), 50)}, 9) AS value FROM samples"
ORACLES["detrend_sinc"] = f"WITH {_S} SELECT signal_id, channel, seq, round({_fir(list(catalog._SINC), 50)}, 9) AS value FROM samples"
ORACLES["fir_overlap_add"] = ORACLES["fir_forward"]
_taps = kernels.np.convolve(kernels.windowed_sinc(256, (49.0, 51.0), 51, stop=True), kernels.windowed_sinc(256, (99.0, 101.0), 51, stop=True))
ORACLES["notch_fir"] = f"WITH {_S} SELECT signal_id, channel, seq, round({_fir(list(_taps), 50)}, 6) AS value FROM samples"
ORACLES["fir_design"] = (
    "WITH t AS (SELECT range AS tap, range - 49.5 AS n FROM range(100)) SELECT tap, round((sin(2 * pi() * 30 / 256 * n) - sin(2 * pi() * 8 / 256 * n)) / (pi() * n) * (0.54 - 0.46 * cos(2 * pi() * tap / 99)), 9) AS h FROM t"
)
ORACLES["detrend_local"] = (
    f"WITH {_S}, c AS (SELECT signal_id, channel, count(*) AS n, least(count(*), 8) AS size, avg(value) AS mean FROM samples GROUP BY ALL), s AS (SELECT DISTINCT signal_id, channel, n, size, unnest(list_append(range(0, n - size + 1, 2), n - size)) AS start FROM c WHERE n >= 3), "
    "l AS (SELECT s.signal_id, s.channel, start, any_value(size) AS size, regr_slope(value, seq - start) AS slope, regr_intercept(value, seq - start) AS base FROM s JOIN samples x ON x.signal_id = s.signal_id AND x.channel = s.channel AND seq >= start AND seq < start + size GROUP BY ALL), "
    "f AS (SELECT l.signal_id, l.channel, start + j AS seq, (1 - abs(2 * (j + 0.5) / size - 1) ** 3) ** 3 AS h, base + slope * j AS line FROM (SELECT *, unnest(range(size)) AS j FROM l) l), "
    "m AS (SELECT signal_id, channel, seq, sum(h * line) / sum(h) AS line FROM f GROUP BY ALL) SELECT signal_id, channel, seq, round(value - CASE WHEN n < 3 THEN mean ELSE line END, 9) AS value FROM samples JOIN c USING (signal_id, channel) LEFT JOIN m USING (signal_id, channel, seq)"
)


def _lines(fitted: str) -> str:
    """``fitted`` gives (signal_id, channel, seq, f) to fit; sines are made orthogonal one after another, and what fits is taken from the value."""
    waves = [f"{w}({2 * math.pi * f / 256!r} * seq)" for f in (50.0, 100.0) for w in ("sin", "cos")]
    part = "OVER (PARTITION BY signal_id, channel)"
    steps = [f"r0 AS (SELECT *, {', '.join(f'{w} AS b{i}' for i, w in enumerate(waves))}, f AS r, value AS v, count(*) {part} AS n FROM ({fitted}))"]
    for k in range(4):
        project = lambda c: f"{c} - b{k} * sum({c} * b{k}) {part} / sum(b{k} * b{k}) {part}"  # noqa: B023, E731
        keep = ", ".join(f"b{i}" for i in range(k + 1)) + "".join(f", {project(f'b{i}')} AS b{i}" for i in range(k + 1, 4))
        steps.append(f"r{k + 1} AS (SELECT signal_id, channel, seq, n, f, value, {keep}, v - b{k} * sum(r * b{k}) {part} / sum(b{k} * b{k}) {part} AS v, {project('r')} AS r FROM r{k})")
    return f"{', '.join(steps)} SELECT signal_id, channel, seq, round(CASE WHEN n > 4 THEN v ELSE value END, 6) AS value FROM r4"


ORACLES["notch"] = f"WITH {_S}, {_lines('SELECT signal_id, channel, seq, value, value AS f FROM samples')}"
ORACLES["line_noise"] = f"WITH {_S}, {_lines(f'SELECT signal_id, channel, seq, value, round({_fir(list(catalog._HIGH), 50)}, 9) AS f FROM samples')}"
ORACLES["resample"] = (
    f"WITH {_S}, c AS (SELECT signal_id, channel, count(*) AS n, round_even(count(*) * 1.5, 0)::BIGINT AS m FROM samples GROUP BY ALL), "
    "d AS MATERIALIZED (SELECT signal_id, channel, k, any_value(n) AS n, any_value(m) AS m, sum(value * cos(2 * pi() * k * seq / n)) AS re, -sum(value * sin(2 * pi() * k * seq / n)) AS im FROM samples JOIN c USING (signal_id, channel), (SELECT unnest(range(4096)) AS k) WHERE k <= n // 2 GROUP BY ALL), "
    "o AS (SELECT signal_id, channel, unnest(range(m)) AS seq FROM c) SELECT signal_id, channel, seq, round(sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * seq / m) - im * sin(2 * pi() * k * seq / m))) / any_value(n), 9) AS value FROM o JOIN d USING (signal_id, channel) GROUP BY signal_id, channel, seq"
)
_poly = ", ".join(repr(float(h)) for h in kernels.windowed_sinc(3, (0.45,), 31))
ORACLES["resample_polyphase"] = (
    f"WITH {_S}, c AS (SELECT signal_id, channel, count(*) AS n FROM samples GROUP BY ALL), o AS (SELECT signal_id, channel, unnest(range(n * 3 // 2)) AS seq FROM c) "
    f"SELECT signal_id, channel, o.seq AS seq, round(sum(3 * value * [{_poly}][o.seq * 2 + 15 - s.seq * 3 + 1]), 6) AS value FROM o JOIN samples s USING (signal_id, channel) WHERE o.seq * 2 + 15 - s.seq * 3 BETWEEN 0 AND 30 GROUP BY ALL"
)

# ---- trials ------------------------------------------------------------------------------

_scaled = ", ".join(f"l_{c} * {s} AS x{i}" for i, (c, s) in enumerate((("quantity", 1.0), ("extendedprice", 1e-3), ("discount", 100.0), ("tax", 100.0))))
_means = ", ".join(f"avg(l_{c}) OVER (PARTITION BY l_suppkey, class ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x{i}" for i, c in enumerate(("quantity", "extendedprice", "discount", "tax")))
_cells = " UNION ALL ".join(f"SELECT trial_id, class, band, {4 * a + b} AS cell, covar_samp(x{a}, x{b}) AS v FROM t GROUP BY ALL HAVING count(*) > 8" for a in range(4) for b in range(4))
ORACLES["csp_cov_cells"] = (
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, l_returnflag AS class FROM lineitem), f AS (SELECT * FROM w WHERE class IN ('A', 'R')), "
    f"t AS (SELECT l_suppkey * 2 + (class = 'R')::INT AS trial_id, class, 0 AS band, {_scaled} FROM f UNION ALL SELECT l_suppkey * 2 + (class = 'R')::INT, class, 1, {_means} FROM f), c AS ({_cells}) SELECT class, band, cell, round(avg(v), 6) AS cov FROM c GROUP BY class, band, cell"
)
