"""Extension points: user code over whole tables, next to SQL that does the same."""

from pyspark.sql import functions as F

from ..operators import extend as ex
from ..sources import views as v
from .base import W, query, with_
from .fitting import role_windows
from .resampling import B, SEED, draws_sql
from .splits import ROLES

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query("frame_table_function", with_(W) + """SELECT vec_id, CAST(k AS INTEGER) AS start, CAST(k + 16 AS INTEGER) AS stop, round(list_sum(list_transform(x[k + 1:k + 16], lambda z: z::DOUBLE)), 6) AS total
  FROM w, range(0, 49, 8) f(k)""")
def _(spark, sf):
    ex.register_frame(spark)
    w = v.windows(spark, sf).select("vec_id", "x")
    return spark.sql("SELECT w.vec_id, f.start, f.stop, round(aggregate(f.part, 0.0D, (a, z) -> a + z), 6) AS total FROM {w} w, LATERAL frame(w.x, 16, 8) f", w=w)


def mirrored(signal, generator, severity):
    """Conjugate signal, scaled."""
    return severity * signal.conj()


@query("user_perturbation", with_(W) + """SELECT vec_id, CAST(k - 1 AS INTEGER) AS severity_index, 5000 + 3 * vec_id + k - 1 AS seed,
  round(list_sum(list_transform(i, lambda z: ([0.5, 2.0])[k] * z)), 5) AS total_i, round(-list_sum(list_transform(q, lambda z: ([0.5, 2.0])[k] * z)), 5) AS total_q
  FROM w, range(1, 3) c(k)""")
def _(spark, sf):
    w = v.iq_windows(spark, sf).select("vec_id", "i", "q")
    d = ex.perturb_user(w, mirrored, (0.5, 2.0), lambda window, case: 5000 + 3 * window + case, "vec_id")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, z: a + z), 5).alias(f"total_{c}")
    return d.select("vec_id", "severity_index", "seed", total("i"), total("q"))


class BandEnergy:
    """Mean squares of 8 bands, standardised per band, and the absolute sum on a log scale, centred."""

    families = ("band", "level")
    BANDS, WIDTH = 8, 8

    def _raw(self, windows):
        bands = F.array(*[F.aggregate(F.slice("x", 1 + k * self.WIDTH, self.WIDTH), F.lit(0.0), lambda a, z: a + z.cast("double") * z.cast("double")) / self.WIDTH for k in range(self.BANDS)])
        d = windows.withColumn("_band", bands)
        return d.withColumn("_level", F.log1p(F.aggregate("x", F.lit(0.0), lambda a, z: a + F.abs(z.cast("double")))))

    def fit(self, source, keys):
        band = [F.col("_band")[k] for k in range(self.BANDS)]
        return self._raw(source).groupBy(*keys).agg(
            F.array(*[F.avg(b) for b in band]).alias("centre"), F.array(*[F.greatest(F.stddev_pop(b), F.lit(1e-8)) for b in band]).alias("spread"), F.avg("_level").alias("middle"))

    def transform_by_family(self, windows, parameters, keys):
        d = self._raw(windows).join(parameters, keys)
        band = F.array(*[(F.col("_band")[k] - F.col("centre")[k]) / F.col("spread")[k] for k in range(self.BANDS)])
        return d.withColumn("band", band).withColumn("level", F.array(F.col("_level") - F.col("middle"))).drop("_band", "_level", "centre", "spread", "middle")


@query("user_representation", with_(ROLES) + """, rw AS (SELECT r.fold_id, r.role, w.vec_id, w.x FROM w JOIN roles r ON r.recording_id = w.recording_id),
 e AS (SELECT fold_id, role, vec_id, b, list_sum(list_transform(x[8 * b + 1:8 * b + 8], lambda z: z::DOUBLE * z::DOUBLE)) / 8 AS e FROM rw, range(8) z(b)),
 p AS (SELECT fold_id, b, avg(e) AS centre, greatest(stddev_pop(e), 1e-8) AS spread FROM e WHERE role = 'source_fit' GROUP BY ALL),
 l AS (SELECT fold_id, role, vec_id, ln(1 + list_sum(list_transform(x, lambda z: abs(z::DOUBLE)))) AS level FROM rw),
 g AS (SELECT fold_id, avg(level) AS middle FROM l WHERE role = 'source_fit' GROUP BY ALL)
 SELECT e.fold_id, e.role, e.vec_id, count(*) + 1 AS n_values, round(sum((e - centre) / spread * (e.b + 1)), 5) AS weighted, round(any_value(level - middle), 6) AS level
 FROM e JOIN p USING (fold_id, b) JOIN l ON l.fold_id = e.fold_id AND l.vec_id = e.vec_id JOIN g ON g.fold_id = e.fold_id GROUP BY e.fold_id, e.role, e.vec_id""")
def _(spark, sf):
    rows = role_windows(spark, sf).select("fold_id", "role", "vec_id", F.col("values").alias("x"))
    d = ex.fit_representation(BandEnergy(), rows, ["fold_id"]).transform(rows)
    weighted = sum((F.col("values")[k] * (k + 1) for k in range(BandEnergy.BANDS)), F.lit(0.0))
    return d.select("fold_id", "role", "vec_id", F.size("values").cast("long").alias("n_values"), F.round(weighted, 5).alias("weighted"), F.round(F.col("values")[BandEnergy.BANDS], 6).alias("level"))


def variation(s):
    """Deviation over mean, from sums."""
    mean = s["x"] / s["n"]
    return F.sqrt(F.greatest(s["xx"] / s["n"] - mean * mean, F.lit(0.0))) / mean


@query("user_statistic", "WITH bl AS (SELECT event_type AS k, user_id AS recording_id, count(value)::DOUBLE AS n, coalesce(sum(value), 0) AS x, coalesce(sum(value * value), 0) AS xx FROM events GROUP BY ALL)"
       + draws_sql("bl", [], ["k"], "recording_id", "dr") + """, st AS (SELECT k, draw, sum(x) / sum(n) AS mean, sum(xx) / sum(n) AS square FROM dr GROUP BY ALL),
  dv AS (SELECT k, sqrt(greatest(square - mean * mean, 0.0)) / mean AS v FROM st), wh AS (SELECT k, count(*) AS blocks, sum(x) / sum(n) AS mean, sum(xx) / sum(n) AS square FROM bl GROUP BY k)
  SELECT k, max(blocks) AS blocks, round(max(sqrt(greatest(square - mean * mean, 0.0)) / mean), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high
  FROM dv JOIN wh USING (k) GROUP BY k""")
def _(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("k"), "user_id", "value")
    value = F.col("value")
    sums = {"n": F.when(value.isNotNull(), 1.0).otherwise(0.0), "x": value, "xx": value * value}
    d = ex.bootstrap_of_sums(e, ["k"], "user_id", sums, variation, B, SEED, F.floor(F.col("recording_id") / 65536))
    return d.select("k", "blocks", *r6("estimate", "low", "high"))
