"""Signal transform queries; complex windows of 32 samples, frames of 8 every 4, 4 x 4 maps."""

from functools import partial

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators import transforms as ops
from ..sources import views as v
from .base import W, query, with_

B, FRAME, HOP, ALPHAS = 4, 8, 4, [0.125, 0.25, 0.375]

IL = W + """, il AS (SELECT vec_id, n, i[n + 1]::DOUBLE AS re, q[n + 1]::DOUBLE AS im FROM w, range(32) z(n))"""
SPEC = IL + """, fs AS (SELECT vec_id, t, f, sum(h * (re * cos(a) + im * sin(a))) AS re, sum(h * (im * cos(a) - re * sin(a))) AS im
  FROM (SELECT vec_id, t, f, re, im, 0.5 - 0.5 * cos(2 * pi() * (n - 4 * t) / 7.0) AS h, 2 * pi() * f * (n - 4 * t) / 8.0 AS a
  FROM il, range(7) tt(t), range(8) ff(f) WHERE n >= 4 * t AND n < 4 * t + 8) GROUP BY ALL)"""


def resize_sql(src, out, h, w, b=B, keys="vec_id"):
    def weights(size):
        return f"""(SELECT k, r, 1 - abs(loc - r) AS wt FROM (SELECT k, k * {size - 1} / {b - 1}.0::DOUBLE AS loc FROM range({b}) a(k)), range({size}) g(r) WHERE abs(loc - r) < 1)"""
    return f""", {out} AS (SELECT {keys}, a.k AS k, c.k AS l, sum(val * a.wt * c.wt) AS val FROM {src} JOIN {weights(h)} a ON a.r = {src}.r JOIN {weights(w)} c ON c.r = {src}.c GROUP BY {keys}, a.k, c.k)"""


def maps(spark, sf, **families):
    return ops.map_windows(v.iq_windows(spark, sf), ["vec_id"], families)


def flat(df, family=False):
    names = ["vec_id"] + (["family"] if family else []) + ["pos"]
    return ops.long_values(df, ["vec_id"]).select(*names, F.round("value", 6).alias("value"))


MAP = "SELECT vec_id, CAST(k * 4 + l AS INTEGER) AS pos, round(val, 6) AS value FROM mp"


@query("stft_power", with_(SPEC) + """SELECT vec_id, CAST(((f + 4) % 8) * 7 + t AS INTEGER) AS pos, round(re * re + im * im, 6) AS value FROM fs""")
def _(spark, sf):
    return flat(maps(spark, sf, S=partial(k.stft_power, frame=FRAME, hop=HOP)))


LOGSTFT = SPEC + ", lp AS (SELECT vec_id, (f + 4) % 8 AS r, t AS c, ln(1 + re * re + im * im) AS val FROM fs)" + resize_sql("lp", "mp", 8, 7)


@query("log_stft", with_(LOGSTFT) + MAP)
def _(spark, sf):
    return flat(maps(spark, sf, S=partial(k.log_stft, bins=B, frame=FRAME, hop=HOP)))


ENERGY = IL + """, le AS (SELECT vec_id, t AS r, sum(re * re + im * im) / 8 AS val FROM il, range(7) tt(t) WHERE n >= 4 * t AND n < 4 * t + 8 GROUP BY ALL),
 e2 AS (SELECT vec_id, r, c, val FROM le, range(2) z(c))"""


@query("energy_map", with_(ENERGY + resize_sql("e2", "mp", 7, 2)) + MAP)
def _(spark, sf):
    return flat(maps(spark, sf, E=partial(k.energy, bins=B, frame=FRAME, hop=HOP)))


@query("frame_energy", with_(ENERGY) + "SELECT vec_id, CAST(r AS INTEGER) AS pos, round(val, 6) AS value FROM le")
def _(spark, sf):
    w = v.iq_windows(spark, sf).select("vec_id", F.posexplode(ops.frame_energy("i", "q", FRAME, HOP)).alias("pos", "value"))
    return w.select("vec_id", "pos", F.round("value", 6).alias("value"))


_SCF = """, al AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) z(r, s)),
 pm AS (SELECT u.vec_id, al.r, u.t, g.f, u.re AS pr, u.im AS pi, m.re AS mr, m.im AS mi FROM al, range(8) g(f), fs u, fs m
  WHERE u.f = (g.f - al.s // 2 + 8) % 8 AND m.f = (g.f + al.s - al.s // 2) % 8 AND u.vec_id = m.vec_id AND u.t = m.t),
 scf AS (SELECT vec_id, r, f, sqrt(pow(avg(pr * mr + pi * mi), 2) + pow(avg(pi * mr - pr * mi), 2)) / sqrt(avg(pr * pr + pi * pi) * avg(mr * mr + mi * mi) + 1e-8) AS val FROM pm GROUP BY ALL)"""


@query("spectral_correlation_native", with_(SPEC + _SCF) + "SELECT vec_id, CAST(r * 8 + f AS INTEGER) AS pos, round(val, 6) AS value FROM scf")
def _(spark, sf):
    return flat(maps(spark, sf, C=partial(k.coherence, alphas=ALPHAS, frame=FRAME, hop=HOP)))


SCFMAP = SPEC + _SCF + ", sh AS (SELECT vec_id, r, (f + 4) % 8 AS c, val FROM scf)" + resize_sql("sh", "mp", 3, 8)


@query("spectral_correlation_map", with_(SCFMAP) + MAP)
def _(spark, sf):
    return flat(maps(spark, sf, C=partial(k.coherence_map, alphas=ALPHAS, bins=B, frame=FRAME, hop=HOP)))


DFT = IL + """, ft AS (SELECT vec_id, f, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im
  FROM (SELECT vec_id, f, re, im, 2 * pi() * f * n / 32.0 AS a FROM il, range(32) ff(f)) GROUP BY ALL)"""

_BANK = """, fq AS (SELECT f, CASE WHEN f < 16 THEN f / 32.0::DOUBLE ELSE (f - 32) / 32.0::DOUBLE END AS nu FROM range(32) z(f)),
 bk0 AS (SELECT b, f, CASE WHEN nu > 0 THEN exp(-0.5 * pow((nu - c) / s, 2)) - exp(-0.5 * pow(c / s, 2)) * exp(-0.5 * pow(nu / s, 2)) ELSE 0 END AS g
  FROM fq, (VALUES (0, 0.45::DOUBLE, 0.45::DOUBLE), (1, 0.225::DOUBLE, 0.225::DOUBLE)) z(b, c, s)),
 bn AS (SELECT b, sum(sqrt(pr * pr + pi * pi)) AS l1 FROM (SELECT b, n, sum(g * cos(2 * pi() * f * n / 32.0)) / 32 AS pr, sum(g * sin(2 * pi() * f * n / 32.0)) / 32 AS pi FROM bk0, range(32) z(n) GROUP BY ALL) GROUP BY b),
 bk AS (SELECT b, f, g / l1 AS g FROM bk0 JOIN bn USING (b)),
 o1 AS (SELECT vec_id, b, n, sqrt(pow(sum(g * (re * cos(a) - im * sin(a))), 2) + pow(sum(g * (re * sin(a) + im * cos(a))), 2)) / 32 AS u
  FROM (SELECT vec_id, b, n, g, re, im, 2 * pi() * ft.f * n / 32.0 AS a FROM ft JOIN bk ON bk.f = ft.f, range(32) z(n)) GROUP BY ALL),
 f1 AS (SELECT vec_id, f, sum(u * cos(2 * pi() * f * n / 32.0)) AS re, -sum(u * sin(2 * pi() * f * n / 32.0)) AS im FROM o1, range(32) z(f) WHERE b = 0 GROUP BY ALL),
 o2 AS (SELECT vec_id, 2 AS b, n, sqrt(pow(sum(g * (re * cos(a) - im * sin(a))), 2) + pow(sum(g * (re * sin(a) + im * cos(a))), 2)) / 32 AS u
  FROM (SELECT vec_id, n, g, re, im, 2 * pi() * f1.f * n / 32.0 AS a FROM f1 JOIN bk ON bk.f = f1.f AND bk.b = 1, range(32) z(n)) GROUP BY ALL),
 pl AS (SELECT vec_id, b AS r, n // 8 AS c, ln(1 + avg(u)) AS val FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) GROUP BY ALL)"""
SCATTER = DFT + _BANK + resize_sql("pl", "mp", 3, 4)


@query("scattering_map", with_(SCATTER) + MAP)
def _(spark, sf):
    return flat(maps(spark, sf, W=partial(k.scattering, j=2, q=1, bins=B)))


@query("resize_2d", with_(W + ", gr AS (SELECT vec_id, p // 8 AS r, p % 8 AS c, x[p + 1]::DOUBLE AS val FROM w, range(64) z(p))" + resize_sql("gr", "mp", 8, 8, 5))
       + "SELECT vec_id, CAST(k * 5 + l AS INTEGER) AS pos, round(val, 6) AS value FROM mp")
def _(spark, sf):
    grid = lambda x: k.resize(x.real.reshape(len(x), 8, 8), 5, 5)
    return flat(ops.map_windows(v.windows(spark, sf), ["vec_id"], {"R": grid}, i="x", q=None))


@query("real_imag", with_(IL) + "SELECT vec_id, CAST(n AS INTEGER) AS pos, round(re, 6) AS channel_0, round(im, 6) AS channel_1 FROM il")
def _(spark, sf):
    w = ops.real_imag(v.iq_windows(spark, sf)).select("vec_id", F.posexplode(F.arrays_zip("channel_0", "channel_1")).alias("pos", "c"))
    return w.select("vec_id", "pos", *[F.round(F.col(f"c.channel_{n}").cast("double"), 6).alias(f"channel_{n}") for n in (0, 1)])


@query("magnitude_phase", with_(IL) + """SELECT vec_id, CAST(n AS INTEGER) AS pos, round(ln(1 + sqrt(re * re + im * im)), 6) AS channel_0, round(atan2(im, re) / pi(), 6) AS channel_1 FROM il""")
def _(spark, sf):
    w = ops.magnitude_phase(v.iq_windows(spark, sf)).select("vec_id", F.posexplode(F.arrays_zip("channel_0", "channel_1")).alias("pos", "c"))
    return w.select("vec_id", "pos", *[F.round(F.col(f"c.channel_{n}"), 6).alias(f"channel_{n}") for n in (0, 1)])


@query("raw_iq_resized", with_(IL + ", rq AS (SELECT vec_id, ch, 0 AS r, n AS c, CASE WHEN ch = 0 THEN re ELSE im END AS val FROM il, range(2) z(ch))"
       + resize_sql("rq", "mp", 1, 32, keys="vec_id, ch")) + "SELECT vec_id, CAST(ch * 16 + k * 4 + l AS INTEGER) AS pos, round(val, 6) AS value FROM mp")
def _(spark, sf):
    return flat(maps(spark, sf, R=partial(k.raw_iq, bins=B)))


@query("cwt_time", with_(IL + """, sc AS (SELECT s, 2 * pow(8.0::DOUBLE, s / 3.0::DOUBLE) AS a FROM range(4) z(s)),
 ato AS (SELECT s, t, exp(-0.5 * pow(t / (1.5 * a), 2)) AS g, 2 * pi() * t / a AS th, greatest(4, ceil(6.75 * a - 1e-9)) AS rad FROM sc, range(-110, 111) z(t)),
 an AS (SELECT s, sqrt(sum(g * g)) AS nm FROM ato WHERE abs(t) <= rad GROUP BY s),
 cv AS (SELECT vec_id, s AS r, m AS c, ln(1 + sqrt(pow(sum(g / nm * (re * cos(th) + im * sin(th))), 2) + pow(sum(g / nm * (im * cos(th) - re * sin(th))), 2))) AS val
  FROM il, range(32) z(m), ato JOIN an USING (s) WHERE t = n - m AND abs(t) <= rad GROUP BY ALL)""" + resize_sql("cv", "mp", 4, 32)) + MAP)
def _(spark, sf):
    return flat(maps(spark, sf, V=partial(k.cwt_time, bins=B, scales=4)))


@query("cwt_frequency", with_(DFT + """, fq AS (SELECT f, CASE WHEN f < 16 THEN f / 32.0::DOUBLE ELSE (f - 32) / 32.0::DOUBLE END AS nu FROM range(32) z(f)),
 ce AS (SELECT s, 0.02 * pow(22.5::DOUBLE, s / 5.0::DOUBLE) AS c FROM range(6) z(s)),
 bk AS (SELECT s, f, exp(-0.5 * pow((nu - c) / greatest(c / 4, 0.008), 2)) AS g FROM fq, ce WHERE nu >= 0),
 o1 AS (SELECT vec_id, s AS r, n AS c, ln(1 + sqrt(pow(sum(g * (re * cos(a) - im * sin(a))), 2) + pow(sum(g * (re * sin(a) + im * cos(a))), 2)) / 32) AS val
  FROM (SELECT vec_id, s, n, g, re, im, 2 * pi() * ft.f * n / 32.0 AS a FROM ft JOIN bk ON bk.f = ft.f, range(32) z(n)) GROUP BY ALL)""" + resize_sql("o1", "mp", 6, 32)) + MAP)
def _(spark, sf):
    return flat(maps(spark, sf, V=partial(k.cwt_frequency, bins=B, scales=6)))


@query("stft_dct", with_(LOGSTFT + """, dm AS (SELECT u, y, cos(pi() * (2 * y + 1) * u / 8.0) * sqrt(0.5) * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END AS b FROM range(4) a(u), range(4) c(y)),
 dc AS (SELECT vec_id, a.u AS u, c.u AS v2, sum(val * a.b * c.b) AS val FROM mp JOIN dm a ON a.y = mp.k JOIN dm c ON c.y = mp.l GROUP BY vec_id, a.u, c.u),
 zz AS (SELECT u, v2, row_number() OVER (ORDER BY u + v2, CASE WHEN (u + v2) % 2 = 1 THEN u ELSE v2 END) - 1 AS pos FROM range(4) a(u), range(4) c(v2))""")
 + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(val, 6) AS value FROM dc JOIN zz USING (u, v2) WHERE pos < 10")
def _(spark, sf):
    return flat(maps(spark, sf, D=partial(k.stft_dct, bins=B, kept=10, frame=FRAME, hop=HOP)))


@query("zigzag_order", """SELECT l_orderkey, l_linenumber, pos FROM (SELECT l_orderkey, l_linenumber, l_partkey % 16 AS r, l_suppkey % 16 AS c FROM lineitem) t
  JOIN (SELECT u AS r, v2 AS c, row_number() OVER (ORDER BY u + v2, CASE WHEN (u + v2) % 2 = 1 THEN u ELSE v2 END) - 1 AS pos FROM range(16) a(u), range(16) b(v2)) z USING (r, c)""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ops.zigzag_rank(F.col("l_partkey") % 16, F.col("l_suppkey") % 16, 16).alias("pos"))


def _db4_level(src, out):
    taps = ", ".join(f"({i}, {t!r}::DOUBLE, {(-1.0) ** i * k.DB4_LOW[7 - i]!r}::DOUBLE)" for i, t in enumerate(k.DB4_LOW))
    return f""", {out} AS (SELECT vec_id, 2 * node + hi AS node, m AS n, len // 2 AS len, sum(CASE WHEN hi = 0 THEN lo_t ELSE hi_t END * re) AS re, sum(CASE WHEN hi = 0 THEN lo_t ELSE hi_t END * im) AS im
  FROM {src}, range(2) z(hi), (VALUES {taps}) tp(j, lo_t, hi_t), range(16) g(m) WHERE m < len // 2 AND 2 * m + 3 - j = n GROUP BY ALL)"""


@query("db4_packet_energy", with_(IL + ", l0 AS (SELECT vec_id, 0 AS node, n, 32 AS len, re, im FROM il)" + _db4_level("l0", "l1") + _db4_level("l1", "l2") + _db4_level("l2", "l3"))
       + "SELECT vec_id, CAST(node AS INTEGER) AS pos, round(ln(1 + sum(re * re + im * im) / 4), 6) AS value FROM l3 GROUP BY vec_id, node")
def _(spark, sf):
    return flat(maps(spark, sf, D=k.packet_energy))


@query("log_psd_sobel", with_(DFT + ", ps AS (SELECT vec_id, 0 AS r, (f + 16) % 32 AS c, ln(1 + re * re + im * im) AS val FROM ft)" + resize_sql("ps", "mp", 1, 32))
       + """, sb AS (SELECT a.vec_id, a.k, a.l, a.val, 4 * (c.val - b.val) AS gx FROM mp a JOIN mp b ON b.vec_id = a.vec_id AND b.k = a.k AND b.l = greatest(a.l - 1, 0)
  JOIN mp c ON c.vec_id = a.vec_id AND c.k = a.k AND c.l = least(a.l + 1, 3))
  SELECT vec_id, CAST(ch * 16 + k * 4 + l AS INTEGER) AS pos, round(CASE ch WHEN 0 THEN val WHEN 1 THEN gx ELSE 0 END, 6) AS value FROM sb, range(3) z(ch)""")
def _(spark, sf):
    return flat(maps(spark, sf, D=partial(k.psd_sobel, bins=B)))


@query("representation_bank")
def _(spark, sf):
    """Both banks over every window; equal raw maps are computed once."""
    configs = list({c.stable_id: c for c in ops.fixed_bank(frame=16, hop=8) + ops.selection_bank(frame=16, hop=8)}.values())
    alphas = {(a, p): [(s + 1) / 32 for s in range(a)][:: -1 if p else 1] for a in (4, 8, 16) for p in (False, True)}
    raw = ops.raw_maps(v.iq_windows(spark, sf), ["vec_id"], configs, alphas)
    bank = ops.representation_bank(raw, configs)
    return bank.groupBy("config_id", "family").agg(
        F.count("*").alias("maps"), F.round(F.avg(F.expr("aggregate(values, 0.0D, (a, z) -> a + z) / size(values)")), 6).alias("mean_value"))
