"""All registered queries of the matrix engine and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Params
from ..operators import consensus, factorize, genesets, manova, markers, matrix, plots, subsets
from ..functions import keyed
from . import inputs, tree_sql
from .base import ITERATIONS, ORACLE_SQL, QUERIES
from .base import query as _query
from .base import rounded as _r
from .inputs import SQL as _INPUTS

__all__ = ["ORACLE_SQL", "QUERIES"]

@_query("SELECT g.i, g.j, round((coalesce(d.value, 0) - g.m) / greatest(0.1 * coalesce(d.value, 0), 0.1), 5) AS residual FROM grid g LEFT JOIN d ON g.i = d.i AND g.j = d.j")
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.residuals(inputs.d(spark, sf), inputs.a(spark, sf), inputs.p(spark, sf)).select("i", "j", _r("residual", 5))


@_query("SELECT g.i, g.j, round(g.m, 6) AS m FROM grid g JOIN (SELECT DISTINCT i, name FROM a) n ON g.i = n.i WHERE n.name IN ('Brand#1', 'Brand#4', 'Brand#9')")
def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.reconstruct(inputs.a(spark, sf), inputs.p(spark, sf), ["Brand#1", "Brand#4", "Brand#9"]).select("i", "j", _r("m"))


@_query("SELECT g.i, g.j, round(g.m, 6) AS m FROM grid g")
def reconstruction_whole(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.reconstruct(inputs.a(spark, sf), inputs.p(spark, sf)).select("i", "j", _r("m"))


@_query("SELECT round(sum(pow((coalesce(d.value, 0) - g.m) / greatest(0.1 * coalesce(d.value, 0), 0.1), 2)), 3) AS chisq FROM grid g LEFT JOIN d ON g.i = d.i AND g.j = d.j")
def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.chi_square(inputs.d(spark, sf), inputs.a(spark, sf), inputs.p(spark, sf)).select(_r("chisq", 3))


@_query(
    "SELECT round(sum(pow((coalesce(d.value, 0) - g.m) / (0.05 + 0.02 * coalesce(d.value, 0)), 2)), 3) AS chisq FROM grid g JOIN d ON g.i = d.i AND g.j = d.j"
)
def chi_square_given_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    d = inputs.d(spark, sf)
    sigma = d.select("i", "j", (0.05 + 0.02 * F.col("value")).alias("value"))
    return matrix.chi_square(d, inputs.a(spark, sf), inputs.p(spark, sf), sigma).select(_r("chisq", 3))


@_query("SELECT round(100 * sum(CASE WHEN coalesce(d.value, 0) > 0 THEN pow((d.value - g.m) / d.value, 2) ELSE g.m * g.m END), 2) AS chisq FROM grid g LEFT JOIN d ON g.i = d.i AND g.j = d.j")
def chi_square_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.chi_square_sparse(inputs.d(spark, sf), inputs.a(spark, sf), inputs.p(spark, sf)).select(_r("chisq", 2))


@_query("SELECT i, j, round(greatest(0.1 * value, 0.1), 6) AS sigma FROM d")
def default_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.with_sigma(inputs.d(spark, sf)).select("i", "j", _r("sigma"))


@_query("SELECT j AS i, i AS j, round(value, 6) AS value FROM d")
def transpose(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.transpose(inputs.d(spark, sf)).select("i", "j", _r("value"))


@_query("SELECT x.pos AS i, d.j, round(d.value, 6) AS value FROM (VALUES (CAST(0 AS BIGINT), 7), (1, 2), (2, 7), (3, 24)) x(pos, idx) JOIN d ON d.i = x.idx")
def subset_rows(spark: SparkSession, sf: str) -> DataFrame:
    index = spark.createDataFrame([(0, 7), (1, 2), (2, 7), (3, 24)], "pos long, idx long")
    return matrix.subset(inputs.d(spark, sf), index, 1).select("i", "j", _r("value"))


@_query(
    """SELECT round(least(min(value), 0), 6) AS min, round(greatest(max(value), 0), 6) AS max, round(sum(value), 4) AS total, round(sum(value) / (count(DISTINCT i) * count(DISTINCT j)), 6) AS mean,
       round(sum(value) / count(*) FILTER (WHERE value > 0), 6) AS nonzero_mean, round(1 - count(*) FILTER (WHERE value > 0) / (count(DISTINCT i) * count(DISTINCT j)), 6) AS sparsity FROM d"""
)
def moments(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.moments(inputs.d(spark, sf)).select(_r("min"), _r("max"), _r("total", 4), _r("mean"), _r("nonzero_mean"), _r("sparsity"))


@_query(
    """SELECT CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS n_missing, CAST(count(*) FILTER (WHERE value < 0) AS BIGINT) AS n_negative, count(*) FILTER (WHERE value > 0) AS n_positive,
       count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_cols, round(max(value), 6) AS largest, max(value) > 50 AS maybe_not_logged,
       round(1 - count(*) FILTER (WHERE value > 0) / (count(DISTINCT i) * count(DISTINCT j)), 6) AS zero_share, 1 - count(*) FILTER (WHERE value > 0) / (count(DISTINCT i) * count(DISTINCT j)) > 0.8 AS maybe_sparse FROM d"""
)
def validation(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.validation(inputs.d(spark, sf)).select("n_missing", "n_negative", "n_positive", "n_rows", "n_cols", _r("largest"), "maybe_not_logged", _r("zero_share"), "maybe_sparse")


@_query("SELECT i, j, round(ln(1 + value / sum(value) OVER (PARTITION BY j) * 10000), 5) AS value FROM d")
def log_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.log_normalize(inputs.d(spark, sf)).select("i", "j", _r("value", 5))


@_query("SELECT i AS idx, k, round(mean / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END, 6) AS z FROM a")
def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.z_scores(inputs.a(spark, sf)).select("idx", "k", _r("z"))


@_query("SELECT i AS idx, k, CASE WHEN mean / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END > 1.765 THEN 1 ELSE 0 END AS on_ FROM a")
def binary_loadings(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.binarized(inputs.a(spark, sf), 1.765).select("idx", "k", F.col("on").alias("on_"))


@_query("SELECT a.i AS idx, a.k, round(a.mean * n.top, 6) AS mean FROM a JOIN (SELECT k, max(mean) AS top FROM p GROUP BY k) n ON a.k = n.k")
def normalized_loadings(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.normalized(inputs.a(spark, sf), inputs.p(spark, sf))[0].select("idx", "k", _r("mean"))


@_query("SELECT p.j AS idx, p.k, round(p.mean / n.top, 6) AS mean FROM p JOIN (SELECT k, max(mean) AS top FROM p GROUP BY k) n ON p.k = n.k")
def normalized_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.normalized(inputs.a(spark, sf), inputs.p(spark, sf))[1].select("idx", "k", _r("mean"))


@_query("SELECT idx, k FROM (SELECT i AS idx, k, row_number() OVER (PARTITION BY i ORDER BY mean DESC, k) AS n FROM a) WHERE n = 1")
def top_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.top_pattern(inputs.a(spark, sf)).select("idx", "k")


@_query("SELECT idx, k, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY iter, idx ORDER BY mean DESC, k) AS n FROM samples) WHERE n = 1 GROUP BY idx, k")
def pump_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.pump(inputs.samples(spark, sf))


@_query("SELECT idx, k, round(avg(mean), 5) AS mean, round(stddev_samp(mean), 5) AS sd FROM samples GROUP BY idx, k")
def posterior_moments(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.posterior(inputs.samples(spark, sf)).select("idx", "k", _r("mean", 5), _r("sd", 5))


@_query("SELECT x.k, y.k AS l, round(corr(x.mean, y.mean), 6) AS r FROM p x JOIN p y ON x.j = y.j GROUP BY x.k, y.k")
def pattern_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.correlations(inputs.p(spark, sf)).select("k", "l", _r("r"))


@_query("SELECT gene_set, k, round(avg(mean), 6) AS mean FROM a JOIN sets USING (name) GROUP BY gene_set, k")
def set_means(spark: SparkSession, sf: str) -> DataFrame:
    return genesets.set_means(inputs.a(spark, sf), inputs.sets(spark, sf)).select("gene_set", "k", _r("mean"))


@_query("SELECT i AS idx, name, k FROM a WHERE name NOT IN (SELECT name FROM sets WHERE gene_set = 'SMALL')")
def set_complement(spark: SparkSession, sf: str) -> DataFrame:
    return genesets.others(inputs.a(spark, sf), inputs.sets(spark, sf).where("gene_set = 'SMALL'")).select("idx", "name", "k")


@_query("SELECT min(n) AS min, round(avg(n), 6) AS mean, max(n) AS max FROM (SELECT gene_set, count(*) AS n FROM sets GROUP BY gene_set)")
def set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return genesets.set_sizes(inputs.sets(spark, sf)).select("min", _r("mean"), "max")


@_query("SELECT gene_set, count(*) AS n FROM sets GROUP BY gene_set")
def set_table(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.tabulate(inputs.sets(spark, sf), "gene_set")


def _marker_sql(rows: str, other: str, key: str, name: str, targets: str, tail: str) -> str:
    return f"""SELECT * FROM (
WITH top AS (SELECT k, max(mean) AS top FROM {other} GROUP BY k),
scaled AS (SELECT x.{key} AS idx, {name} AS name, x.k, x.mean * top.top AS v FROM {rows} x JOIN top ON x.k = top.k),
unit AS (SELECT idx, name, k, v / max(v) OVER (PARTITION BY idx) AS v FROM scaled),
lp AS (SELECT * FROM (VALUES {targets}) t(lp, target, k, x)),
scored AS (SELECT idx, name, lp, target, round(sqrt(sum((v - x) * (v - x))), 9) AS score FROM unit JOIN lp USING (k) GROUP BY idx, name, lp, target),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lp ORDER BY score, idx) AS BIGINT) AS rank FROM scored),
best AS (SELECT *, min(rank) OVER (PARTITION BY idx) AS least, row_number() OVER (PARTITION BY idx ORDER BY rank, target) AS first FROM ranked),
cuts AS (SELECT *, min(CASE WHEN rank > least THEN rank END) OVER (PARTITION BY lp) AS cut FROM best)
SELECT idx, name, lp, round(score, 6) AS score, rank, {tail} AS is_marker FROM cuts)"""


_ONE_HOT = ", ".join(f"('Pattern_{t + 1}', {t}, {k}, {float(t == k)})" for t in range(3) for k in range(3))
_TWO = "('flat', 0, 0, 1.0), ('flat', 0, 1, 1.0), ('flat', 0, 2, 1.0), ('edge', 1, 0, 1.0), ('edge', 1, 1, 0.0), ('edge', 1, 2, 0.5)"


def _markers(frame: DataFrame) -> DataFrame:
    return frame.select("idx", "name", "lp", _r("score"), "rank", "is_marker")


@_query(_marker_sql("a", "p", "i", "x.name", _ONE_HOT, "first = 1"))
def pattern_markers_all(spark: SparkSession, sf: str) -> DataFrame:
    return _markers(markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf)))


@_query(_marker_sql("a", "p", "i", "x.name", _ONE_HOT, "cut IS NULL OR rank < cut"))
def pattern_markers_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _markers(markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf), "cut"))


@_query(_marker_sql("p", "a", "j", "'S' || CAST(x.j AS VARCHAR)", _ONE_HOT, "first = 1"))
def pattern_markers_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _markers(markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf), axis=2))


@_query(_marker_sql("a", "p", "i", "x.name", _TWO, "first = 1"))
def pattern_markers_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _markers(markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf), lp={"flat": [1, 1, 1], "edge": [1, 0, 0.5]}))


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.p(spark, sf)
    return p.select(F.when(F.col("k") == 2, 1).otherwise(0).alias("cluster"), F.concat(F.lit("1."), (F.col("k") + 1).cast("string")).alias("pattern"), "idx", F.col("mean").alias("value"))


_CLUSTERED = """, c AS (SELECT CASE WHEN k = 2 THEN 1 ELSE 0 END AS cluster, '1.' || CAST(k + 1 AS VARCHAR) AS pattern, j AS idx, mean AS value FROM p),
cm AS (SELECT *, avg(value) OVER (PARTITION BY cluster, idx) AS mean FROM c),
r AS (SELECT cluster, pattern, round(corr(value, mean), 3) AS r FROM cm GROUP BY cluster, pattern)
"""


@_query(_CLUSTERED + "SELECT cluster, pattern, r FROM r")
def correlation_to_mean(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.correlation_to_mean(_clustered(spark, sf))


@_query(
    _CLUSTERED
    + """, w AS (SELECT c.cluster, c.idx, sum(r * r * r * value) / sum(r * r * r) AS value FROM c JOIN r ON c.cluster = r.cluster AND c.pattern = r.pattern GROUP BY c.cluster, c.idx)
SELECT cluster, idx, round(value / max(value) OVER (PARTITION BY cluster), 5) AS value FROM w"""
)
def consensus_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus_patterns(_clustered(spark, sf)).select("cluster", "idx", _r("value", 5))


@_query(
    """SELECT CAST(least(floor((n - 1) / (t // 4)), 3) AS INTEGER) AS set_id, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY i) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT i FROM d)) GROUP BY 1"""
)
def uniform_set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    ids = inputs.d(spark, sf).select(F.col("i").alias("idx")).distinct()
    return subsets.uniform_sets(ids, 4, 1).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


_ORA = _marker_sql("a", "p", "i", "x.name", _ONE_HOT, "first = 1")


@_query(
    f""", mk AS ({_ORA}),
n AS (SELECT lp, count(*) AS n_markers FROM mk WHERE is_marker GROUP BY lp),
s AS (SELECT gene_set, count(*) AS size FROM sets GROUP BY gene_set),
u AS (SELECT count(DISTINCT name) AS total FROM mk),
o AS (SELECT lp, gene_set, count(*) AS overlap FROM mk JOIN sets USING (name) WHERE is_marker GROUP BY lp, gene_set),
t AS (SELECT n.lp, s.gene_set, coalesce(o.overlap, 0) AS overlap, s.size, n.n_markers, u.total FROM n CROSS JOIN s CROSS JOIN u LEFT JOIN o ON o.lp = n.lp AND o.gene_set = s.gene_set),
x AS (SELECT *, unnest(generate_series(greatest(overlap, n_markers + size - total, 0), least(n_markers, size))) AS h FROM t),
pr AS (SELECT lp, gene_set, overlap, size, n_markers, least(1.0, sum(exp(lgamma(size + 1) - lgamma(h + 1) - lgamma(size - h + 1) + lgamma(total - size + 1) - lgamma(n_markers - h + 1) - lgamma(total - size - n_markers + h + 1)
       - lgamma(total + 1) + lgamma(n_markers + 1) + lgamma(total - n_markers + 1)))) AS p FROM x GROUP BY ALL),
b AS (SELECT *, p * count(*) OVER (PARTITION BY lp) / count(*) OVER (PARTITION BY lp ORDER BY p RANGE UNBOUNDED PRECEDING) AS scaled FROM (SELECT lp, gene_set, overlap, size, n_markers, round(p, 9) AS p FROM pr))
SELECT lp, gene_set, overlap, size, n_markers, round(p, 6) AS p, round(least(1.0, min(scaled) OVER (PARTITION BY lp ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS padj, round(overlap / size, 6) AS ratio,
       round(-10 * log10(least(1.0, min(scaled) OVER (PARTITION BY lp ORDER BY p DESC RANGE UNBOUNDED PRECEDING))), 4) + 0.0 AS neg_log_padj FROM b"""
)
def overrepresentation(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf))
    return genesets.overrepresentation(found, inputs.sets(spark, sf)).select("lp", "gene_set", "overlap", "size", "n_markers", _r("p"), _r("padj"), _r("ratio"), _r("neg_log_padj", 4))


@_query(
    """, r AS (SELECT k, g.gene_set, a.name, round(a.mean, 9) AS score, CASE WHEN s.name IS NULL THEN 0 ELSE 1 END AS hit FROM a CROSS JOIN (SELECT DISTINCT gene_set FROM sets) g LEFT JOIN sets s ON s.gene_set = g.gene_set AND s.name = a.name),
st AS (SELECT *, CASE WHEN hit = 1 THEN abs(score) / sum(hit * abs(score)) OVER w ELSE -1.0 / greatest(count(*) OVER w - sum(hit) OVER w, 1) END AS step FROM r WINDOW w AS (PARTITION BY k, gene_set)),
ru AS (SELECT *, sum(step) OVER (PARTITION BY k, gene_set ORDER BY score DESC, name ROWS UNBOUNDED PRECEDING) AS run FROM st)
SELECT k, gene_set, CAST(sum(hit) AS BIGINT) AS size, round(greatest(max(run), 0), 6) AS es FROM ru GROUP BY k, gene_set"""
)
def enrichment_scores(spark: SparkSession, sf: str) -> DataFrame:
    ranked = inputs.a(spark, sf).withColumn("mean", F.round("mean", 9))
    return genesets.enrichment_scores(ranked, inputs.sets(spark, sf)).select("k", "gene_set", "size", _r("es"))


_PILLAI = """, x AS (SELECT p.j AS idx, p.k, p.mean, s.s_nationkey AS first, floor(s.s_acctbal / 1000) AS second FROM p JOIN supplier s ON s.s_suppkey = p.j),
y AS (SELECT idx, k, mean, dense_rank() OVER (ORDER BY first) AS first, dense_rank() OVER (ORDER BY second) AS second FROM x),
s AS (SELECT k, count(*) AS n, corr(mean, first) AS r1, corr(mean, second) AS r2, corr(first, second) AS r12 FROM y GROUP BY k)
SELECT k, n, round(v, 6) AS pillai, round(v / (1 - v) * (n - 3) / 2, 4) AS f, round(pow(1 - v, (n - 3) / 2), 6) AS p
FROM (SELECT *, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS v FROM s)"""


@_query(_PILLAI)
def manova_pillai(spark: SparkSession, sf: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("first"), F.floor(F.col("s_acctbal") / 1000).alias("second"))
    sold = supplier.join(inputs.p(spark, sf).select("idx").distinct(), "idx", "left_semi")
    return manova.manova(sold, inputs.p(spark, sf), "first", "second").select("k", "n", _r("pillai"), _r("f", 4), _r("p"))


# --- permutations ---------------------------------------------------------------

_PERMUTATIONS = 1000
_STATISTICS = f""", z AS (SELECT i AS idx, name, k, mean / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END AS z FROM a),
zp AS (SELECT z.*, n.place FROM z JOIN (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS place FROM (SELECT DISTINCT idx FROM z)) n USING (idx)),
own AS (SELECT DISTINCT gene_set, name FROM sets),
size0 AS (SELECT gene_set, count(*) AS n FROM own GROUP BY gene_set),
actual AS (SELECT gene_set, k, avg(z) AS actual FROM z JOIN own USING (name) GROUP BY gene_set, k),
{keyed.distinct_places_sql("size0", "SELECT count(DISTINCT idx) FROM z", _PERMUTATIONS, 1)},
nulls AS (SELECT n, perm, k, avg(z) AS m FROM drawn JOIN zp USING (place) GROUP BY n, perm, k),
stats AS (SELECT gene_set, k, sum(CASE WHEN round(actual, 12) < round(m, 12) THEN 1 ELSE 0 END) / {_PERMUTATIONS}.0 AS up FROM actual JOIN size0 USING (gene_set) JOIN nulls USING (n, k) GROUP BY gene_set, k)
"""


@_query(_STATISTICS + f"SELECT gene_set, k, round(up, 6) AS up, round(1 - up, 6) AS down, round(1 - 2 * up, 6) AS activity, round(greatest(least(up, 1 - up), 1.0 / {_PERMUTATIONS}), 6) AS two_sided FROM stats")
def set_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = genesets.set_statistics(inputs.a(spark, sf), inputs.sets(spark, sf), _PERMUTATIONS)
    return out.select("gene_set", "k", _r("up"), _r("down"), _r("activity"), _r("two_sided"))


_GENES = _STATISTICS + """, w AS (SELECT k, -ln(CASE WHEN up > 0 THEN up ELSE 0.0005 END) AS w FROM stats WHERE gene_set = 'SMALL'),
sums AS (SELECT idx, name, name IN (SELECT name FROM own WHERE gene_set = 'SMALL') AS is_own, sum(z * w) AS zw, sum(w) AS w, sum(z) AS z FROM z JOIN w USING (k) GROUP BY idx, name),
gs AS (SELECT idx, name, is_own, CASE WHEN z < 1e-6 OR w < 1e-6 THEN 0.0 ELSE zw / w / z END AS stat FROM sums)
"""


@_query(_GENES + "SELECT idx, name, round(stat, 6) AS stat FROM gs WHERE is_own")
def gene_statistics(spark: SparkSession, sf: str) -> DataFrame:
    one = inputs.sets(spark, sf).where("gene_set = 'SMALL'")
    found = genesets.set_statistics(inputs.a(spark, sf), one, _PERMUTATIONS)
    return genesets.gene_statistics(inputs.a(spark, sf), one, found).select("idx", "name", _r("stat"))


@_query(_GENES + "SELECT o.name, round(avg(CASE WHEN round(n.stat, 12) > round(o.stat, 12) THEN 1.0 ELSE 0.0 END), 6) AS p FROM gs o CROSS JOIN gs n WHERE o.is_own AND NOT n.is_own GROUP BY o.name")
def gene_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return genesets.gene_probabilities(inputs.a(spark, sf), inputs.sets(spark, sf).where("gene_set = 'SMALL'"), _PERMUTATIONS).select("name", _r("p"))


_ENRICHMENT = f""", rk AS (SELECT k, name, round(mean, 9) AS score, row_number() OVER (PARTITION BY k ORDER BY round(mean, 9) DESC, name) AS place, count(*) OVER (PARTITION BY k) AS g FROM a),
own AS (SELECT DISTINCT gene_set, name FROM sets),
hit AS (SELECT k, gene_set, name, place, score, g, row_number() OVER w AS i, count(*) OVER (PARTITION BY k, gene_set) AS n, sum(score) OVER w AS part, sum(score) OVER (PARTITION BY k, gene_set) AS whole FROM rk JOIN own USING (name) WINDOW w AS (PARTITION BY k, gene_set ORDER BY place)),
run AS (SELECT *, round(part / whole - (place - i) / greatest(g - n, 1), 12) AS run FROM hit),
es AS (SELECT k, gene_set, any_value(n) AS n, greatest(max(run), 0) AS es, arg_max(place, run - place * 1e-15) AS peak FROM run GROUP BY k, gene_set),
edge AS (SELECT k, gene_set, string_agg(name, ',' ORDER BY place) AS leading_edge FROM run JOIN es USING (k, gene_set) WHERE place <= peak GROUP BY k, gene_set),
{keyed.distinct_places_sql("es", "SELECT count(DISTINCT name) FROM a", _PERMUTATIONS, 1)},
nh AS (SELECT n, perm, k, rk.place, g, row_number() OVER w AS i, sum(score) OVER w AS part, sum(score) OVER (PARTITION BY n, perm, k) AS whole FROM drawn JOIN rk ON rk.place = drawn.place + 1 WINDOW w AS (PARTITION BY n, perm, k ORDER BY rk.place)),
ne AS (SELECT n, perm, k, greatest(max(round(part / whole - (place - i) / greatest(g - n, 1), 12)), 0) AS nes FROM nh GROUP BY n, perm, k),
t AS (SELECT es.k, gene_set, es.n AS size, es, (sum(CASE WHEN nes >= es THEN 1 ELSE 0 END) + 1) / ({_PERMUTATIONS} + 1) AS p, avg(nes) AS center FROM es JOIN ne ON ne.n = es.n AND ne.k = es.k GROUP BY es.k, gene_set, es.n, es),
bh AS (SELECT *, p * count(*) OVER (PARTITION BY k) / count(*) OVER (PARTITION BY k ORDER BY p RANGE UNBOUNDED PRECEDING) AS scaled FROM t)
SELECT k, gene_set, size, round(es, 6) AS es, round(es / center, 5) AS nes, round(p, 6) AS p, round(padj, 6) AS padj, round(-10 * log10(padj), 4) + 0.0 AS neg_log_padj, leading_edge
FROM (SELECT *, least(1.0, min(scaled) OVER (PARTITION BY k ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS padj FROM bh) JOIN edge USING (k, gene_set)"""


@_query(_ENRICHMENT)
def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    ranked = inputs.a(spark, sf).withColumn("mean", F.round("mean", 9))
    out = genesets.enrichment(ranked, inputs.sets(spark, sf), _PERMUTATIONS)
    return out.select("k", "gene_set", "size", _r("es"), _r("nes", 5), _r("p"), _r("padj"), _r("neg_log_padj", 4), "leading_edge")


@_query(
    f""", size0 AS (SELECT gene_set, count(*) AS n FROM (SELECT DISTINCT gene_set, name FROM sets) GROUP BY gene_set), {keyed.distinct_places_sql("size0", "SELECT count(DISTINCT i) FROM a", 20, 7)}
SELECT n, perm, place FROM drawn"""
)
def permuted_places(spark: SparkSession, sf: str) -> DataFrame:
    sizes = inputs.sets(spark, sf).groupBy("gene_set").agg(F.count(F.lit(1)).alias("n"))
    places, total = genesets.placed(inputs.a(spark, sf))
    return genesets.permuted_places(sizes, total, 20, 7)


@_query(
    f"""{_ORA.join([", mk AS (", ")"])},
n AS (SELECT lp, count(*) AS n_markers FROM mk WHERE is_marker GROUP BY lp)
SELECT lp, n_markers AS n, CAST(sum(n_markers) OVER (ORDER BY lp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM n"""
)
def marker_separators(spark: SparkSession, sf: str) -> DataFrame:
    return plots.separators(markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf))).select("lp", "n", F.col("upto").cast("long").alias("upto"))


@_query(f"""{_ORA.join([", mk AS (", ")"])} SELECT lp, string_agg(name, ',' ORDER BY rank) AS names FROM mk WHERE is_marker GROUP BY lp""")
def marker_lists(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.marker_lists(markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf)))
    return found.select("lp", F.array_join("names", ",").alias("names")).where("names != ''")


# --- tables behind figures --------------------------------------------------------


@_query("SELECT 'Pattern_' || CAST(k + 1 AS VARCHAR) AS pattern, j AS x, 'S' || CAST(j AS VARCHAR) AS name, round(mean, 6) AS y FROM p")
def pattern_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plots.pattern_lines(inputs.p(spark, sf)).select("pattern", "x", "name", _r("y"))


@_query(
    """SELECT pattern, dense_rank() OVER (ORDER BY "group") - 1 AS x, "group", n, y FROM (
SELECT 'Pattern_' || CAST(k + 1 AS VARCHAR) AS pattern, s_nationkey AS "group", count(*) AS n, round(avg(mean), 6) AS y FROM p JOIN supplier ON s_suppkey = j GROUP BY ALL)"""
)
def pattern_lines_by_group(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("group"))
    return plots.pattern_lines(inputs.p(spark, sf), groups).select("pattern", "x", "group", "n", _r("y"))


@_query(
    """SELECT i, j, round(greatest(least(r, 5), -5), 5) AS shade FROM (
SELECT g.i, g.j, (coalesce(d.value, 0) - g.m) / greatest(0.1 * coalesce(d.value, 0), 0.1) AS r FROM grid g LEFT JOIN d ON g.i = d.i AND g.j = d.j)"""
)
def residual_map(spark: SparkSession, sf: str) -> DataFrame:
    return plots.residual_map(matrix.residuals(inputs.d(spark, sf), inputs.a(spark, sf), inputs.p(spark, sf))).select("i", "j", _r("shade", 5))


_BARS = ORACLE_SQL["overrepresentation"].removeprefix(_INPUTS).replace("SELECT lp, gene_set, overlap, size, n_markers, round(p, 6) AS p,", ", bars AS (SELECT lp, gene_set, overlap, size, n_markers, round(p, 6) AS p,") + ")"


@_query(_BARS + " SELECT lp, gene_set, padj, neg_log_padj FROM bars WHERE padj < 0.9")
def significant_sets(spark: SparkSession, sf: str) -> DataFrame:
    return genesets.significant(overrepresentation(spark, sf), 0.9).select("lp", "gene_set", "padj", "neg_log_padj")


@_query(_BARS + " SELECT lp, gene_set, neg_log_padj, round(-10 * log10(0.9), 6) AS line FROM bars WHERE padj < 0.9")
def set_bars(spark: SparkSession, sf: str) -> DataFrame:
    return plots.set_bars(overrepresentation(spark, sf), 0.9).select("lp", "gene_set", "neg_log_padj", _r("line"))


@_query(
    f"""{_ORA.join([", mk AS (", ")"])}, mine AS (SELECT mk.lp, mk.rank, mk.idx AS i, mk.name, d.j, d.value FROM mk JOIN d ON d.i = mk.idx WHERE is_marker), own AS (SELECT DISTINCT i, j, value FROM mine),
{tree_sql.tree("tg", *tree_sql.correlation_distances("own", "i"), "average")}, {tree_sql.tree("ts", *tree_sql.correlation_distances("own", "j"), "average")}
SELECT lp, rank, i, name, j, round(value, 6) AS value, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 5) AS scaled, CAST(tg.place AS INTEGER) AS gene_place, CAST(ts.place AS INTEGER) AS sample_place
FROM mine JOIN tg ON tg.idx = i JOIN ts ON ts.idx = j WINDOW w AS (PARTITION BY lp, i)"""
)
def marker_heat_map(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.pattern_markers(inputs.a(spark, sf), inputs.p(spark, sf))
    return plots.marker_heat_map(inputs.d(spark, sf), found).select("lp", "rank", "i", "name", "j", _r("value"), _r("scaled", 5), "gene_place", "sample_place")


@_query(f", {tree_sql.tree('t', *tree_sql.correlation_distances('d', 'i'), 'average')} SELECT idx, CAST(place AS INTEGER) AS place, round(height, 8) AS height FROM t")
def marker_tree_order(spark: SparkSession, sf: str) -> DataFrame:
    return plots.tree_order(inputs.d(spark, sf)).select("idx", "place", _r("height", 8))


# --- without an SQL twin: chains ---------------------------------------------------


@_query()
def factorization(spark: SparkSession, sf: str) -> DataFrame:
    cell = inputs.zero_based(inputs.d(spark, sf))
    return factorize.factorize(cell, Params(3, n_iterations=ITERATIONS, seed=42)).factors


@_query()
def factorization_sparse(spark: SparkSession, sf: str) -> DataFrame:
    cell = inputs.zero_based(inputs.d_sparse(spark, sf))
    return factorize.factorize(cell, Params(3, n_iterations=ITERATIONS // 10, seed=42, sparse=True)).factors


@_query()
def two_stage_factorization(spark: SparkSession, sf: str) -> DataFrame:
    cell = inputs.zero_based(inputs.d(spark, sf))
    return factorize.factorize(cell, Params(3, n_iterations=ITERATIONS, seed=42, distributed="genome-wide", n_sets=3, min_ns=1)).factors


from . import chains, files, scalars  # noqa: E402, F401  (they register their queries)
