"""Signal filters over the event series and over ready-made fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import filters, resume
from sigspark.plans.registry import FRAGMENTS, NUMBERED, ORACLES, SIGNAL, fragments, query, rnd, signal
from sigspark.session import fresh_dir

KEYS, ORDER = ["dev"], ["us", "id"]
W = "PARTITION BY dev ORDER BY us, id"


def _filtered(name: str, digits: int = 6, scale: float = 1.0, extra: dict | None = None, **params):
    def run(spark, sf):
        df = signal(spark, sf).drop("ch").withColumn("value", F.col("value") * scale)
        out = filters.apply_filter(df, name, KEYS, ORDER, **params)
        more = [rnd(c, digits).alias(a) for c, a in (extra or {}).items()]
        return out.select("id", rnd("filtered", digits).alias("filtered"), rnd("residual", digits).alias("residual"), *more)

    return run


def _frame_sql(expr: str, digits: int = 6) -> str:
    return f"""WITH {SIGNAL}, f AS (SELECT id, value, {expr} AS y FROM s)
SELECT id, round(y, {digits}) + 0.0 AS filtered, round(value - y, {digits}) + 0.0 AS residual FROM f"""


def _recursive_sql(first: str, then: str, y: str, digits: int = 6, source: str = NUMBERED, extra: str = "", scale: str = "1.0") -> str:
    """``first``/``then`` list the state columns at row 0 and after; ``y`` the output from the state."""
    return f"""WITH RECURSIVE {source}, g AS (SELECT * REPLACE (value * {scale} AS value) FROM n),
f AS (SELECT dev, i, id, value, {first} FROM g n WHERE i = 0
  UNION ALL SELECT n.dev, n.i, n.id, n.value, {then} FROM f JOIN g n ON n.dev = f.dev AND n.i = f.i + 1)
SELECT id, round({y}, {digits}) + 0.0 AS filtered, round(value - ({y}), {digits}) + 0.0 AS residual{extra} FROM f"""


def _lag(i: int, missing: str = "0.0") -> str:
    return "value" if i == 0 else f"coalesce(lag(value, {i}) OVER ({W}), {missing})"


def _last(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _when_full(n: int, expr: str) -> str:
    return f"CASE WHEN count(*) {_last(n)} < {n} THEN value ELSE {expr} END"


query("f00_unknown_passes_through", f"WITH {SIGNAL} SELECT id, round(value, 6) AS filtered, 0.0::DOUBLE AS residual FROM s")(
    _filtered("NO_SUCH_FILTER"))
query("f00_unknown_uses_moving_average", _frame_sql(f"sum(value) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20"))(
    _filtered("NO_SUCH_FILTER", unknown="MOVING_AVERAGE"))
query("f01_mean", _frame_sql(f"avg(value) {_last(10)}"))(_filtered("MEAN"))
query("f02_median", _frame_sql(f"list_sort(list(value) {_last(10)})[(count(*) {_last(10)}) // 2 + 1]"))(_filtered("MEDIAN"))
_kernel = "exp(-((9 - {i} - 5) * (9 - {i} - 5)) / 8.0)"
_gauss = " + ".join(f"{_kernel.format(i=i)} * {_lag(i)}" for i in range(10))
_norm = " + ".join(_kernel.format(i=i) for i in range(10))
query("f03_gaussian", _frame_sql(_when_full(10, f"({_gauss}) / ({_norm})")))(_filtered("GAUSSIAN"))
query("f04_fir", _frame_sql(" + ".join(f"{t} * {_lag(i)}" for i, t in enumerate([.05, .1, .2, .3, .2, .1, .05]))))(_filtered("FIR"))
query("f05_iir", _recursive_sql("value AS y", "0.1 * n.value + 0.9 * f.y", "y"))(_filtered("IIR"))
query("f06_morphology", _frame_sql(f"(min(value) {_last(5)} + max(value) {_last(5)}) / 2"))(_filtered("MORPHOLOGY"))
_bw = "exp(-{i} * {i} / 8.0 - (({v}) - value) * (({v}) - value) / 0.5)"
_top = " + ".join(f"coalesce({_bw.format(i=i, v=_lag(i, 'NULL'))} * {_lag(i, 'NULL')}, 0)" for i in range(10))
_bot = " + ".join(f"coalesce({_bw.format(i=i, v=_lag(i, 'NULL'))}, 0)" for i in range(10))
query("f07_bilateral", _frame_sql(f"({_top}) / ({_bot})"))(_filtered("BILATERAL"))
_sg = " + ".join(f"{c} * {_lag(i)}" for i, c in enumerate([-3, 12, 17, 12, -3]))
query("f08_sg_smooth", _frame_sql(_when_full(5, f"({_sg}) / 35.0")))(_filtered("SG_SMOOTH"))
_wv = f"greatest(var_pop(value) {_last(10)}, 0.1)"
query("f09_wiener", _frame_sql(_when_full(10, f"avg(value) {_last(10)} + ({_wv} - 0.1) / {_wv} * (value - avg(value) {_last(10)})")))(
    _filtered("WIENER"))
query("f10_wavelet", _recursive_sql(
    "value AS y", "f.y + sign(n.value - f.y) * greatest(0, abs(n.value - f.y) - 0.5)", "y"))(_filtered("WAVELET"))

_K = "(f.p + {q}) / (f.p + {q} + {r})"


def _kalman_sql(q: str, r: str, first: str, digits: int = 6) -> str:
    k = _K.format(q=q, r=r)
    return _recursive_sql(first, f"f.y + {k} * (n.value - f.y), (1 - {k}) * (f.p + {q})", "y", digits)


_PLAIN = _kalman_sql("1e-5", "0.1", "value AS y, 1.0::DOUBLE AS p")
query("f11_kalman", _PLAIN)(_filtered("KALMAN"))
query("f16_ekf", _PLAIN)(_filtered("EKF"))
query("f16_ukf", _PLAIN)(_filtered("UKF"))
query("f12_kalman_zero_start", _kalman_sql("0.001", "0.1", "value * (1.001 / 1.101) AS y, (1 - 1.001 / 1.101) * 1.001::DOUBLE AS p"))(
    _filtered("KALMAN_ZERO"))
query("f13_kalman_mean_start", _recursive_sql(
    "value AS y, 1.0::DOUBLE AS p",
    "CASE WHEN n.i < 10 THEN (f.y * n.i + n.value) / (n.i + 1) ELSE f.y + " + _K.format(q="1e-5", r="0.1") + " * (n.value - f.y) END, "
    "CASE WHEN n.i < 10 THEN 1.0 ELSE (1 - " + _K.format(q="1e-5", r="0.1") + ") * (f.p + 1e-5) END", "y"))(_filtered("KALMAN_MEAN"))


@query("f14_kalman_level_fragments", f"""WITH RECURSIVE {FRAGMENTS},
f AS (SELECT frag, i, v AS y, 1.0::DOUBLE AS p FROM x WHERE i = 0
  UNION ALL SELECT x.frag, x.i, f.y + (f.p + 1e-3) / (f.p + 1e-3 + 1e-2) * (x.v - f.y), (1 - (f.p + 1e-3) / (f.p + 1e-3 + 1e-2)) * (f.p + 1e-3)
  FROM f JOIN x ON x.frag = f.frag AND x.i = f.i + 1)
SELECT frag, i, round(y, 6) + 0.0 AS filtered, 'ok' AS status FROM f""")
def f14(spark, sf):
    out = filters.filter_fragments(fragments(spark, sf), "KALMAN_LEVEL")
    return out.select("frag", "status", F.posexplode("filtered").alias("i", "y")).select("frag", "i", rnd("y").alias("filtered"), "status")


def _velocity_sql(predict: bool) -> str:
    """The 2 x 2 covariance written out; columns a b c d of P after prediction."""
    q, mv = ("0.01", "f.x + f.v") if predict else ("0", "f.x")
    pa = "(f.a + f.b + f.c + f.d + 0.01)" if predict else "f.a"
    pb = "(f.b + f.d)" if predict else "f.b"
    pc = "(f.c + f.d)" if predict else "f.c"
    pd = "(f.d + 0.01)" if predict else "f.d"
    k0, k1, e = f"({pa} / ({pa} + 0.1))", f"({pc} / ({pa} + 0.1))", f"(n.value - ({mv}))"
    return f"""WITH RECURSIVE {NUMBERED},
f AS (SELECT dev, i, id, value, value AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0.0::DOUBLE AS e FROM n WHERE i = 0
  UNION ALL SELECT n.dev, n.i, n.id, n.value, {mv} + {k0} * {e}, f.v + {k1} * {e},
    {pa} - {k0} * {pa}, {pb} - {k0} * {pb}, {pc} - {k1} * {pa}, {pd} - {k1} * {pb}, {e}
  FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1)
SELECT id, round(x, 6) + 0.0 AS filtered, round(value - x, 6) + 0.0 AS residual, round(v, 6) + 0.0 AS velocity,
  round(e, 6) + 0.0 AS innovation, round(sqrt(a), 6) + 0.0 AS uncertainty FROM f"""


_VELOCITY = {"velocity": "velocity", "innovation": "innovation", "uncertainty": "uncertainty"}
query("f15_kalman_velocity", _velocity_sql(True))(_filtered("KALMAN_VELOCITY", extra=_VELOCITY))
query("f15_kalman_velocity_update_only", _velocity_sql(False))(_filtered("KALMAN_VELOCITY", extra=_VELOCITY, predict=False))

_TAPS = f"""{SIGNAL}, t AS (SELECT dev, us, id, value * {{scale}} AS value FROM s),
n AS (SELECT *, row_number() OVER ({W}) - 1 AS i, [{", ".join(_lag(k) for k in range(8))}] AS taps,
  coalesce(lag(value, 3) OVER ({W}), 0.0) AS want FROM t)"""


def _lms_sql(rate: str, scale: str, digits: int) -> str:
    """Weights as a list; ``rate`` is the full factor in front of error times tap."""
    dot, err = "list_dot_product(f.w, n.taps)", "(n.value - list_dot_product(f.w, n.taps))"
    first = rate.replace("n.", "")
    return f"""WITH RECURSIVE {_TAPS.format(scale=scale)},
f AS (SELECT dev, i, id, value, 0.0::DOUBLE AS y, list_transform(range(1, 9), lambda k: {first} * value * taps[k]) AS w FROM n WHERE i = 0
  UNION ALL SELECT n.dev, n.i, n.id, n.value, {dot}, list_transform(range(1, 9), lambda k: f.w[k] + {rate} * {err} * n.taps[k])
  FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1)
SELECT id, round(y, {digits}) + 0.0 AS filtered, round(value - y, {digits}) + 0.0 AS residual FROM f"""


query("f17_lms", _lms_sql("0.02", "0.002", 6))(_filtered("LMS", scale=0.002))
query("f18_nlms", _lms_sql("(0.2 / (list_dot_product(n.taps, n.taps) + 1e-6))", "1.0", 4))(_filtered("NLMS", 4))


def _desired_sql(move: str, digits: int) -> str:
    """LMS towards a delayed signal; ``move`` is the factor of each tap given the error ERR."""
    err = "(n.want - list_dot_product(f.w, n.taps))"
    first = move.replace("ERR", "want").replace("n.", "")
    return f"""WITH RECURSIVE {_TAPS.format(scale="0.002")},
f AS (SELECT dev, i, id, 0.0::DOUBLE AS y, want AS e, list_transform(range(1, 9), lambda k: {first} * taps[k]) AS w FROM n WHERE i = 0
  UNION ALL SELECT n.dev, n.i, n.id, list_dot_product(f.w, n.taps), {err}, list_transform(range(1, 9), lambda k: f.w[k] + {move.replace("ERR", err)} * n.taps[k])
  FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1)
SELECT id, round(y, {digits}) + 0.0 AS filtered, round(e, {digits}) + 0.0 AS error, round(sqrt(list_dot_product(w, w)), {digits}) + 0.0 AS weight_norm FROM f"""


def _desired(name: str, digits: int):
    def run(spark, sf):
        df = signal(spark, sf).withColumn("value", F.col("value") * 0.002)
        df = filters.with_delayed(df, KEYS, ORDER, "value", 3)
        out = filters.apply_filter(df, name, KEYS, ORDER)
        return out.select("id", *[rnd(c, digits).alias(c) for c in ("filtered", "error", "weight_norm")])

    return run


query("f19_sign_lms", _desired_sql("(CASE WHEN ERR > 0 THEN 0.01 ELSE -0.01 END)", 6))(_desired("SIGN_LMS", 6))
query("f20_log_nlms", _desired_sql(
    "(CASE WHEN ERR = 0 THEN 0.0 ELSE 0.001 * log10(10 * ERR * ERR) / (0.01 + sqrt(list_dot_product(n.taps, n.taps))) * ERR END)", 5))(
    _desired("LOG_NLMS", 5))


@query("f21_delayed_signal", f"WITH {SIGNAL} SELECT id, coalesce(lag(value, 3) OVER ({W}), 0.0) AS desired FROM s")
def f21(spark, sf):
    return filters.with_delayed(signal(spark, sf), KEYS, ORDER, "value", 3).select("id", "desired")


query("f22_rls_scalar", _recursive_sql(
    "value * (100.0 / 100.99) AS y, (100.0 - 100.0 / 100.99 * 100.0) / 0.99::DOUBLE AS p",
    "f.y + f.p / (0.99 + f.p) * (n.value - f.y), (f.p - f.p / (0.99 + f.p) * f.p) / 0.99", "y"))(_filtered("RLS"))

_RLS_TREND = f"""WITH RECURSIVE {NUMBERED},
f AS (SELECT dev, i, id, value, value * (1000.0 / 1000.99) AS w0, 0.0::DOUBLE AS w1,
    (1000.0 - 1000.0 / 1000.99 * 1000.0) / 0.99::DOUBLE AS a, 0.0::DOUBLE AS b, 1000.0 / 0.99::DOUBLE AS d FROM n WHERE i = 0
  UNION ALL SELECT dev, i, id, value, w0 + g0 / den * e, w1 + g1 / den * e,
    (a - g0 / den * g0) / 0.99, (b - g0 / den * g1) / 0.99, (d - g1 / den * g1) / 0.99
  FROM (SELECT n.dev, n.i, n.id, n.value, f.w0, f.w1, f.a, f.b, f.d, f.a + f.b * n.i AS g0, f.b + f.d * n.i AS g1,
      0.99 + (f.a + f.b * n.i) + n.i * (f.b + f.d * n.i) AS den, n.value - f.w0 - f.w1 * n.i AS e
    FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1))
SELECT id, round(w0 + w1 * i, 3) + 0.0 AS filtered, round(value - w0 - w1 * i, 3) + 0.0 AS residual,
  round(w0, 3) + 0.0 AS level, round(w1, 3) + 0.0 AS trend FROM f"""
query("f23_rls_trend", _RLS_TREND)(_filtered("RLS_TREND", 3, extra={"level": "level", "trend": "trend"}))
query("f23_rls_level", _recursive_sql(
    "value * (1000.0 / 1000.99) AS y, (1000.0 - 1000.0 / 1000.99 * 1000.0) / 0.99::DOUBLE AS p",
    "f.y + f.p / (0.99 + f.p) * (n.value - f.y), (f.p - f.p / (0.99 + f.p) * f.p) / 0.99", "y"))(_filtered("RLS", p0=1000.0))


@query("f24_line_fit", f"""WITH {NUMBERED}, k AS (SELECT dev, count(*) + 0.5 AS a, sum(i) AS st, sum(i * i) + 0.5 AS d, sum(value) AS sy, sum(i * value) AS sty FROM n GROUP BY dev)
SELECT dev, round((sy * d - sty * st) / (a * d - st * st), 6) + 0.0 AS level, round((sty * a - st * sy) / (a * d - st * st), 6) + 0.0 AS trend FROM k""")
def f24(spark, sf):
    from sigspark.operators.series import positions

    numbered = positions(signal(spark, sf), KEYS, ORDER, "i")
    out = filters.fit_line(numbered, ["dev"], "i", "value", "trend", ridge=0.5)
    return out.select("dev", rnd("level").alias("level"), rnd("trend").alias("trend"))


@query("f24_level_fit", f"WITH {SIGNAL} SELECT dev, round(sum(value) / (count(*) + 0.5), 6) AS level, 0.0::DOUBLE AS trend FROM s GROUP BY dev")
def f24_level(spark, sf):
    out = filters.fit_line(signal(spark, sf), ["dev"], "us", "value", "level", ridge=0.5)
    return out.select("dev", rnd("level").alias("level"), "trend")


def _biquad_sql(stages: int, coeffs: str, digits: int = 6, scale: str = "1.0", steady: bool = False, single: bool = False) -> str:
    """Direct-form sections in series; ``coeffs`` is a one-row CTE k with b{s}0 .. a{s}2 per stage s.

    ``steady``: low-pass sections of unit gain that have seen the first sample for ever; ``single``: rounded to float32 between stages."""
    first, then, prev_first, prev_then = [], [], "value", "n.value"
    for s in range(stages):
        y0 = f"k.b{s}0 * {prev_first}"
        if steady:
            first += [f"value::DOUBLE AS {c}" for c in (f"x{s}1", f"x{s}2", f"y{s}1", f"y{s}2")]
            y = f"(k.b{s}0 * {prev_then} + k.b{s}1 * f.x{s}1 + k.b{s}2 * f.x{s}2 - k.a{s}1 * f.y{s}1 - k.a{s}2 * f.y{s}2)"
            then += [prev_then, f"f.x{s}1", y, f"f.y{s}1"]
            prev_then = y
            continue
        y = f"(k.b{s}0 * {prev_then} + k.b{s}1 * f.x{s}1 + k.b{s}2 * f.x{s}2 - k.a{s}1 * f.y{s}1 - k.a{s}2 * f.y{s}2)"
        first += [f"({prev_first})::DOUBLE AS x{s}1", f"0.0::DOUBLE AS x{s}2", f"({y0})::DOUBLE AS y{s}1", f"0.0::DOUBLE AS y{s}2"]
        then += [prev_then, f"f.x{s}1", y, f"f.y{s}1"]
        prev_first, prev_then = (f"({y0})::FLOAT::DOUBLE", f"{y}::FLOAT::DOUBLE") if single else (f"({y0})", y)
    last = f"y{stages - 1}1" + ("::FLOAT::DOUBLE" if single else "")
    return f"""WITH RECURSIVE {NUMBERED}, k AS ({coeffs}), g AS (SELECT * REPLACE (value * {scale} AS value) FROM n),
f AS (SELECT dev, i, id, value, {", ".join(first)} FROM g n, k WHERE i = 0
  UNION ALL SELECT n.dev, n.i, n.id, n.value, {", ".join(then)} FROM f JOIN g n ON n.dev = f.dev AND n.i = f.i + 1 JOIN k ON true)
SELECT id, round({last}, {digits}) + 0.0 AS filtered, round(value - {last}, {digits}) + 0.0 AS residual FROM f"""


query("f25_butterworth", _biquad_sql(1, """SELECT 0.020083365564211225::DOUBLE AS b00, 0.04016673112842245::DOUBLE AS b01,
  0.020083365564211225::DOUBLE AS b02, -1.5610180758007182::DOUBLE AS a01, 0.6413515380575631::DOUBLE AS a02"""))(_filtered("BUTTERWORTH"))
query("f26_chebyshev", _biquad_sql(1, """SELECT 0.0183::DOUBLE AS b00, 0.0366::DOUBLE AS b01, 0.0183::DOUBLE AS b02,
  -1.5::DOUBLE AS a01, 0.58::DOUBLE AS a02""", scale="0.27182818284"))(_filtered("CHEBYSHEV", scale=0.27182818284))
query("f27_bandpass_sections", _biquad_sql(2, """SELECT (1 + c0) / 2 / (1 + s0) AS b00, -(1 + c0) / (1 + s0) AS b01, (1 + c0) / 2 / (1 + s0) AS b02,
  -2 * c0 / (1 + s0) AS a01, (1 - s0) / (1 + s0) AS a02, (1 - c1) / 2 / (1 + s1) AS b10, (1 - c1) / (1 + s1) AS b11, (1 - c1) / 2 / (1 + s1) AS b12,
  -2 * c1 / (1 + s1) AS a11, (1 - s1) / (1 + s1) AS a12
  FROM (SELECT cos(2 * pi() * 1e5 / 2e6) AS c0, sin(2 * pi() * 1e5 / 2e6) / sqrt(2) AS s0, cos(2 * pi() * 9e5 / 2e6) AS c1, sin(2 * pi() * 9e5 / 2e6) / sqrt(2) AS s1)"""))(
    _filtered("BANDPASS_SECTIONS"))


def _resumed(name: str, digits: int = 6, scale: float = 1.0):
    """The series in two batches, the second one from the state that the first one has written."""
    def run(spark, sf):
        df, path = signal(spark, sf).drop("ch").withColumn("value", F.col("value") * scale), fresh_dir(spark, "filter-state")
        early = F.col("us") < F.unix_micros(F.lit("2024-01-12").cast("timestamp"))
        parts = [resume.resume_filter(df.filter(t), name, KEYS, ORDER, path, i) for i, t in enumerate((early, ~early))]
        return parts[0].unionByName(parts[1]).select("id", rnd("filtered", digits).alias("filtered"), rnd("residual", digits).alias("residual"))

    return run


def _single_precision(spark, sf):
    out = filters.repeated_single(signal(spark, sf).drop("ch"), KEYS, ORDER)
    return out.select("id", rnd("filtered", 4).alias("filtered"), rnd("residual", 4).alias("residual"))


@query("f15_rising_sequence", f"WITH {SIGNAL}, q AS (SELECT *, id % 37 AS seq FROM s), t AS (SELECT *, coalesce(max(seq) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM q), d AS (SELECT *, count(*) FILTER (WHERE seq <= top) OVER ({W}) AS dropped FROM t) SELECT id, dropped FROM d WHERE seq > top")
def f15_rising(spark, sf):
    """Rows whose number does not rise are left out and counted before the velocity filter sees them."""
    s = signal(spark, sf).withColumn("seq", F.col("id") % 37)
    kept = filters.rising(s, KEYS, ORDER, "seq")
    return filters.apply_filter(kept, "KALMAN_VELOCITY", KEYS, ORDER).select("id", "dropped")


query("f27_resumed_batches", ORACLES["f27_bandpass_sections"])(_resumed("BANDPASS_SECTIONS"))
query("f17_resumed_batches", ORACLES["f17_lms"])(_resumed("LMS", scale=0.002))
_STAGE = ", ".join(
    f"(1 - c) / 2 / (1 + a) AS b{s}0, (1 - c) / (1 + a) AS b{s}1, (1 - c) / 2 / (1 + a) AS b{s}2, -2 * c / (1 + a) AS a{s}1, (1 - a) / (1 + a) AS a{s}2"
    for s in (0, 1))
query("f28_biquad_repeated", _biquad_sql(2, f"""SELECT {_STAGE} FROM (SELECT cos(w) AS c, sin(w) * (hi - lo) / (2 * w) AS a
  FROM (SELECT sqrt(lo * hi) AS w, lo, hi FROM (SELECT 2 * pi() * 1e4 / 1e6 AS lo, 2 * pi() * 5e5 / 1e6 AS hi)))"""))(_filtered("BIQUAD_REPEATED"))
query("f28_biquad_single_precision", _biquad_sql(2, f"""SELECT {_STAGE} FROM (SELECT cos(w) AS c, sin(w) * (hi - lo) / (2 * w) AS a
  FROM (SELECT sqrt(lo * hi) AS w, lo, hi FROM (SELECT 2 * pi() * 1e4 / 1e6 AS lo, 2 * pi() * 5e5 / 1e6 AS hi)))""", digits=4, single=True))(
    _single_precision)


def _butterworth_sql(order: int, cutoff: float) -> str:
    """Low-pass sections of unit gain by the bilinear transform, ``cutoff`` as a fraction of Nyquist."""
    cols = ", ".join(
        f"t * t / (1 + t * q{s} + t * t) AS b{s}0, 2 * t * t / (1 + t * q{s} + t * t) AS b{s}1, t * t / (1 + t * q{s} + t * t) AS b{s}2, "
        f"2 * (t * t - 1) / (1 + t * q{s} + t * t) AS a{s}1, (1 - t * q{s} + t * t) / (1 + t * q{s} + t * t) AS a{s}2" for s in range(order // 2))
    damping = ", ".join(f"2 * cos(pi() * {2 * s + 1} / {2 * order}) AS q{s}" for s in range(order // 2))
    return f"SELECT {cols} FROM (SELECT tan(pi() * {cutoff} / 2) AS t, {damping})"


query("f29_lowpass", _biquad_sql(2, _butterworth_sql(4, 0.04), steady=True))(_filtered("LOWPASS"))
query("f30_bandpass")(_filtered("BANDPASS"))


@query("f31_zero_phase")
def f31(spark, sf):
    out = filters.zero_phase_fragments(fragments(spark, sf))
    return out.select("frag", F.posexplode("filtered").alias("i", "y")).select("frag", "i", rnd("y").alias("filtered"))


query("f32_lowpass_sections", _biquad_sql(3, _butterworth_sql(6, 0.2)))(_filtered("LOWPASS_SOS"))
query("f33_moving_average", _frame_sql(f"sum(value) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20"))(_filtered("MOVING_AVERAGE"))


@query("f34_adaptive_notch", f"""WITH RECURSIVE {NUMBERED}, g AS (SELECT dev, i, id, value, sin(2 * pi() * 50.0 * (us // 1000 / 1000.0)) AS r1, cos(2 * pi() * 50.0 * (us // 1000 / 1000.0)) AS r2 FROM n),
f AS (SELECT dev, i, id, value AS e, 0.02 * value * r1 AS w1, 0.02 * value * r2 AS w2 FROM g WHERE i = 0
  UNION ALL SELECT dev, i, id, e, w1 + 0.02 * e * r1, w2 + 0.02 * e * r2
  FROM (SELECT g.*, f.w1, f.w2, g.value - f.w1 * g.r1 - f.w2 * g.r2 AS e FROM f JOIN g ON g.dev = f.dev AND g.i = f.i + 1))
SELECT id, round(e, 4) + 0.0 AS filtered FROM f""")
def f34(spark, sf):
    df = signal(spark, sf).withColumn("ts_ms", F.floor(F.col("us") / 1000))
    return filters.apply_filter(df, "ADAPTIVE_NOTCH", KEYS, ORDER).select("id", rnd("filtered", 4).alias("filtered"))


query("f35_particle")(_filtered("PARTICLE"))


@query("f36_multichannel", """WITH RECURSIVE w AS (SELECT l_suppkey AS dev, l_orderkey AS o, l_linenumber AS ln, l_quantity, l_discount, l_tax, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
c AS (SELECT dev, i, 'quantity' AS channel, l_quantity AS v FROM w UNION ALL SELECT dev, i, 'discount', l_discount FROM w UNION ALL SELECT dev, i, 'tax', l_tax FROM w),
f AS (SELECT dev, channel, i, v AS y FROM c WHERE i = 0 UNION ALL
  SELECT c.dev, c.channel, c.i, 0.1 * c.v + 0.9 * f.y FROM f JOIN c ON c.dev = f.dev AND c.channel = f.channel AND c.i = f.i + 1)
SELECT dev, channel, i, round(y, 6) + 0.0 AS filtered FROM f""")
def f36(spark, sf):
    from sigspark.operators.series import positions
    from sigspark.plans.registry import table

    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    items = table(spark, sf, "lineitem").select("l_suppkey", *order, "l_discount", "l_tax")
    wide = positions(items, ["l_suppkey"], order, "i").select(
        F.col("l_suppkey").alias("dev"), "i", F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = filters.melt_channels(wide, ["quantity", "discount", "tax"])
    out = filters.apply_filter(long, "IIR", ["dev", "channel"], ["i"])
    return out.select("dev", "channel", "i", rnd("filtered").alias("filtered"))


@query("f37_failure_policy", f"""WITH RECURSIVE {FRAGMENTS}, b AS (SELECT frag FROM e WHERE samples[1] < -0.1),
f AS (SELECT frag, i, v AS y FROM x WHERE i = 0 UNION ALL SELECT x.frag, x.i, 0.1 * x.v + 0.9 * f.y FROM f JOIN x ON x.frag = f.frag AND x.i = f.i + 1)
SELECT x.frag, x.i, CASE WHEN b.frag IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN b.frag IS NOT NULL AND x.i = 0 THEN NULL ELSE round(CASE WHEN b.frag IS NULL THEN f.y ELSE x.v END, 6) + 0.0 END AS filtered
FROM x JOIN f ON f.frag = x.frag AND f.i = x.i LEFT JOIN b ON b.frag = x.frag""")
def f37(spark, sf):
    bad = F.when(F.get("samples", F.lit(0)) < -0.1, F.concat(F.array(F.lit(float("nan"))), F.slice("samples", F.lit(2), F.size("samples")))).otherwise(F.col("samples"))
    out = filters.filter_fragments(fragments(spark, sf).withColumn("samples", bad), "IIR")
    out = out.select("frag", "status", F.posexplode("filtered").alias("i", "y"))
    return out.select("frag", "i", "status", rnd(F.when(~F.isnan("y"), F.col("y"))).alias("filtered"))
