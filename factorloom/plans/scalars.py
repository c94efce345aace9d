"""Queries of scalar functions, vector kernels, keyed draws and the sampler's arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, special
from ..operators import consensus, gram, kernel, matrix, subsets, trees
from ..runtime import checkpointed, ship_package
from . import inputs, tree_sql
from .base import query, rounded

#: Values from a table as the functions' arguments: x in [0, 0.1] and z in [-2.5, 2.5].
_ARGUMENTS = "SELECT DISTINCT l_discount AS x, l_discount * 50 - 2.5 AS z FROM lineitem"
_CDF = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(sign(z) * exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) + ln(sqrt(pi())) - (n + 1) * ln(2) - lgamma(n + 1.5))) FROM generate_series(0, 60) g(n))"


def _arguments(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_discount")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(x.alias("x"), (x * 50 - 2.5).alias("z")).distinct()


@query(f", v AS ({_ARGUMENTS}) SELECT round(z, 6) AS z, round(exp(-z * z / 2) / sqrt(2 * pi()), 9) AS pdf, round({_CDF}, 8) AS cdf, round(z, 6) AS quantile FROM v")
def normal_functions(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    cdf = special.normal_cdf(z)
    out = _arguments(spark, sf).select(z, special.normal_pdf(z).alias("pdf"), cdf.alias("cdf"), special.normal_quantile(cdf).alias("quantile"))
    return out.select(rounded("z"), rounded("pdf", 9), rounded("cdf", 8), rounded("quantile"))


@query(
    f""", v AS ({_ARGUMENTS}), y AS (SELECT x * 100 + 0.5 AS y FROM v)
SELECT round(y, 6) AS y, round(exp(ln(y) - y / 2) / 4, 9) AS pdf, round((SELECT sum(exp((2 + n) * ln(y / 2) - y / 2 - lgamma(3 + n))) FROM generate_series(0, 80) g(n)), 8) AS cdf, round(y, 6) AS quantile, round(lgamma(y), 8) AS log_gamma FROM y"""
)
def gamma_functions(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("y")
    two = lambda f, x: f(x, 2.0, 2.0)
    rows = _arguments(spark, sf).select((F.col("x") * 100 + 0.5).alias("y"))
    out = rows.select(y, two(special.gamma_pdf, y).alias("pdf"), two(special.gamma_cdf, y).alias("cdf"), special.log_gamma(y).alias("log_gamma"))
    return out.select(rounded("y"), rounded("pdf", 9), rounded("cdf", 8), F.round(two(special.gamma_quantile, F.col("cdf")), 6).alias("quantile"), rounded("log_gamma", 8))


@query("SELECT p_partkey, trim(' \"' || p_name || '\" ', ' \"') AS name, upper(p_name) || '-' || CAST(length(p_name) AS VARCHAR) AS label FROM part")
def trimmed_names(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    name = scalars.trimmed(F.concat(F.lit(' "'), F.col("p_name"), F.lit('"\r\n ')))
    return part.select("p_partkey", name.alias("name"), F.concat_ws("-", F.upper("p_name"), F.length("p_name").cast("string")).alias("label"))


@query("SELECT DISTINCT p_size, printf('%02d:%02d:%02d', p_size * 977 // 3600, p_size * 977 // 60 % 60, p_size * 977 % 60) AS clock FROM part")
def clock_times(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_size", scalars.clock(F.col("p_size") * 977).alias("clock")).distinct()


@query("SELECT i, k, " + ", ".join(f"CAST(CASE WHEN k = {n} THEN 1 ELSE 0 END AS DOUBLE) AS {x}" for n, x in enumerate(("first", "second", "third"))) + " FROM a")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = scalars.one_hot(3, F.col("k"))
    return inputs.a(spark, sf).select(F.col("idx").alias("i"), "k", v[0].alias("first"), v[1].alias("second"), v[2].alias("third"))


@query(
    """, v AS (SELECT i, max(CASE WHEN k = 0 THEN mean END) AS x, max(CASE WHEN k = 1 THEN mean END) AS y, max(CASE WHEN k = 2 THEN mean END) AS z FROM a GROUP BY i)
SELECT i, round(x * x + y * y + z * z, 5) AS dot, round(x * (x - 1) + y * (y - 2) + z * (z - 3), 5) AS dot_difference, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS which_max, false AS is_zero, round(x * x, 5) AS first_squared FROM v"""
)
def vector_kernels(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    target = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    out = matrix.folded(inputs.a(spark, sf)).select(
        F.col("idx").alias("i"),
        matrix.dot(v, v).alias("dot"),
        scalars.dot_difference_of(v, v, target).alias("dot_difference"),
        scalars.place_of_max(v).alias("which_max"),
        scalars.all_zero(v).alias("is_zero"),
        F.transform(v, lambda x: x * x)[0].alias("first_squared"),
    )
    return out.select("i", rounded("dot", 5), rounded("dot_difference", 5), "which_max", "is_zero", rounded("first_squared", 5))


# --- keyed draws --------------------------------------------------------------------


@query(
    """, o AS (SELECT i, row_number() OVER (ORDER BY md5('1:' || CAST(i AS VARCHAR)), i) - 1 AS n, count(*) OVER () AS t FROM (SELECT DISTINCT i FROM d)),
s AS (SELECT i, least(n // (t // 4), 3) AS set_id FROM o)
SELECT CAST(set_id AS INTEGER) AS set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY i) - 1 AS INTEGER) AS pos, i AS idx FROM s"""
)
def uniform_sets(spark: SparkSession, sf: str) -> DataFrame:
    return subsets.uniform_sets(inputs.d(spark, sf).select(F.col("i").alias("idx")).distinct(), 4, 1)


_U = "CAST('0x' || substr(md5('5:' || CAST(set_id AS VARCHAR) || ':' || CAST(t AS VARCHAR) || ':{}'), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(
    f""", mem AS (SELECT p_type AS name, p_partkey AS idx, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS size FROM part),
t AS (SELECT s.set_id, t.t FROM generate_series(0, 2) s(set_id) CROSS JOIN (SELECT unnest(range(greatest(1, count(*) // 3))) AS t FROM part) t),
dr AS (SELECT set_id, t, CASE WHEN {_U.format(0)} < 0.25 THEN 'PROMO' WHEN {_U.format(0)} < 1.0 THEN 'SMALL' END AS name, {_U.format(1)} AS v FROM t)
SELECT CAST(set_id AS INTEGER) AS set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY idx, t) - 1 AS INTEGER) AS pos, idx FROM dr JOIN mem ON mem.name = dr.name AND mem.place = floor(dr.v * mem.size)"""
)
def weighted_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of parts, drawn by the weights of their types."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("name"))
    return subsets.weighted_sets(part, {"SMALL": 3.0, "LARGE": 0.0, "PROMO": 1.0}, 3, 5)


@query("SELECT CAST(set_id AS INTEGER) AS set_id, CAST(pos AS INTEGER) AS pos, i AS idx FROM (VALUES (0, 0, 'Brand#4'), (0, 1, 'Brand#2'), (1, 0, 'Brand#9'), (1, 1, 'Brand#4')) x(set_id, pos, name) JOIN (SELECT DISTINCT i, name FROM a) USING (name)")
def explicit_sets(spark: SparkSession, sf: str) -> DataFrame:
    names = inputs.a(spark, sf).select("idx", "name").distinct()
    return subsets.explicit_sets(spark, (("Brand#4", "Brand#2"), ("Brand#9", "Brand#4")), names)


# --- clusters ------------------------------------------------------------------------

_PATTERNS = """, pat AS (SELECT CAST(iter AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS pattern, idx, mean AS value FROM samples), num AS (SELECT pattern, row_number() OVER (ORDER BY pattern) - 1 AS idx FROM (SELECT DISTINCT pattern FROM pat)),
cor AS (SELECT p.idx AS x, q.idx AS y, 1 - r AS d FROM (SELECT a.pattern AS a, b.pattern AS b, corr(a.value, b.value) AS r FROM pat a JOIN pat b ON a.idx = b.idx AND a.pattern < b.pattern GROUP BY ALL) JOIN num p ON p.pattern = a JOIN num q ON q.pattern = b),
""" + tree_sql.tree("tr", "SELECT idx FROM num", "SELECT * FROM cor", "complete")


def _clustered(cut: int, least: int, most: int) -> str:
    return _PATTERNS + ", " + tree_sql.bounded("bc", "tr", cut, least, most) + " SELECT num.pattern, CAST(cluster AS INTEGER) AS cluster FROM bc JOIN num USING (idx)"


def _clusters(spark: SparkSession, sf: str, cut: int, least: int, most: int) -> DataFrame:
    found = inputs.samples(spark, sf).select(F.concat_ws(".", "iter", "k").alias("label"), "idx", F.col("mean").alias("value"))
    return consensus.cluster(checkpointed(gram.correlations(found)), cut, least, most).select("pattern", "cluster")


@query(_clustered(5, 2, 99))
def clustered_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of line numbers and return flags over brands, by complete linkage, without loners."""
    return _clusters(spark, sf, 5, 2, 99)


@query(_clustered(2, 2, 4))
def split_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters over the most are split where they were joined last."""
    return _clusters(spark, sf, 2, 2, 4)


@query(_PATTERNS + " SELECT idx, place, round(height, 8) AS height FROM tr")
def pattern_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tree: order and heights."""
    found = checkpointed(gram.correlations(inputs.samples(spark, sf).select(F.concat_ws(".", "iter", "k").alias("label"), "idx", F.col("mean").alias("value"))))
    numbered = found.where("a = b").select(F.col("a").alias("label"), (F.row_number().over(Window.orderBy("a")) - 1).cast("long").alias("n"))
    ends = [numbered.select(F.col("label").alias(e), F.col("n").alias(to)) for e, to in (("a", "x"), ("b", "y"))]
    distances = found.where("a < b").join(ends[0], "a").join(ends[1], "b").select("x", "y", (1 - F.col("r")).alias("d"))
    return trees.agglomerate(numbered.select(F.col("n").alias("idx")), distances).select("idx", "place", rounded("height", 8))


# --- the sampler's arithmetic ----------------------------------------------------------

_S = ", w AS (SELECT g.i, g.j, g.m, coalesce(d.value, 0) AS d, greatest(0.1 * coalesce(d.value, 0), 0.1) AS s FROM grid g LEFT JOIN d ON d.i = g.i AND d.j = g.j)"


def _coefficients(sparse: bool):
    """The task that gives each row's slope s_mu and information s at the given factors, from the kernel's coefficients."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("j")
        data, v = rows["value"].to_numpy()[None, :], np.stack(rows["pv"].to_numpy())
        model = kernel.SparseRows(kernel.Cells.of(data)) if sparse else kernel.DenseRows(data, np.maximum(0.1 * data, 0.1))
        b, g = model.coefficients(v)
        a = np.asarray(rows["av"].iloc[0])
        k = len(a)
        slope = b[0] - g[0] @ a
        return pd.DataFrame({"i": key[0], "k": np.arange(k), "s": g[0].diagonal(), "s_mu": slope, "s_next": [g[0][x, x] + g[0][y, y] - 2 * g[0][x, y] for x, y in ((x, (x + 1) % k) for x in range(k))], "s_mu_next": slope - np.roll(slope, -1), "s_mu_more": slope - 2.0 * g[0].diagonal()})

    return run


def _information(spark: SparkSession, sf: str, sparse: bool) -> DataFrame:
    ship_package(spark)
    left = matrix.folded(inputs.a(spark, sf)).select(F.col("idx").alias("i"), F.col("v").alias("av"))
    right = matrix.folded(inputs.p(spark, sf)).select(F.col("idx").alias("j"), F.col("v").alias("pv"))
    grid = matrix.product(inputs.a(spark, sf), inputs.p(spark, sf)).select("i", "j")
    full = grid.join(inputs.d(spark, sf), ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).join(left, "i").join(right, "j")
    out = full.groupBy("i").applyInPandas(_coefficients(sparse), "i long, k int, s double, s_mu double, s_next double, s_mu_next double, s_mu_more double")
    relative = lambda c: F.round(F.col(c) / F.greatest(F.abs(c), F.lit(1.0)) * F.log1p(F.abs(c)), 6).alias(c)
    return out.select("i", "k", *[relative(c) for c in ("s", "s_mu", "s_next", "s_mu_next", "s_mu_more")])


def _information_sql(sigma: str) -> str:
    relative = lambda e, n: f"round(({e}) / greatest(abs({e}), 1.0) * ln(1 + abs({e})), 6) AS {n}"
    return (
        _S
        + f""", c AS (SELECT w.i, x.k, sum(x.mean * x.mean / pow({sigma}, 2)) AS s, sum(x.mean * (w.d - w.m) / pow({sigma}, 2)) AS u, sum(pow(x.mean - y.mean, 2) / pow({sigma}, 2)) AS sn, sum((x.mean - y.mean) * (w.d - w.m) / pow({sigma}, 2)) AS un,
sum(x.mean * (w.d - w.m - 2.0 * x.mean) / pow({sigma}, 2)) AS um
FROM w JOIN p x ON x.j = w.j JOIN p y ON y.j = w.j AND y.k = (x.k + 1) % 3 GROUP BY w.i, x.k)
SELECT i, k, {relative('s', 's')}, {relative('u', 's_mu')}, {relative('sn', 's_next')}, {relative('un', 's_mu_next')}, {relative('um', 's_mu_more')} FROM c"""
    )


@query(_information_sql("w.s"))
def element_information(spark: SparkSession, sf: str) -> DataFrame:
    """s and s_mu of every element, of a pair of neighbours, and with 2 more in the element, dense."""
    return _information(spark, sf, False)


@query(_information_sql("(CASE WHEN w.d > 0 THEN 0.1 * w.d ELSE 0.1 END)"))
def element_information_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The same under the sparse model."""
    return _information(spark, sf, True)


_DRAWS = "double"


def _draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        u, mean = x["x"].to_numpy() * 9 + 0.05, x["z"].to_numpy()
        drawn, valid = kernel.truncated_normal(u, mean, np.ones(len(u)), 0.0, 1.0)
        low, high = (np.array([scalars.normal_cdf(c, m) for m in mean]) for c in (0.0, 1.0))
        back = (np.array([scalars.normal_cdf(v, m) for v, m in zip(drawn, mean, strict=True)]) - low) / (high - low)
        gamma = kernel.truncated_gamma(u, np.full(len(u), 3.0), 2.0)
        top = scalars.gamma_cdf(3.0, 2, 2.0)
        yield pd.DataFrame({"z": mean, "u": back, "valid": valid, "v": [scalars.gamma_cdf(g, 2, 2.0) / top for g in gamma], "exponential": -np.log1p(-u)})


@query(
    f""", v AS ({_ARGUMENTS}), e AS (SELECT x, z, -z AS z0, 1 - z AS z1 FROM v),
q AS (SELECT x, z, {_CDF.replace("z", "z0")} AS low, {_CDF.replace("z", "z1")} AS high FROM e)
SELECT round(z, 6) AS z, round(x * 9 + 0.05, 4) AS u, low <= 0.95 AND high >= 0.05 AS valid, round(x * 9 + 0.05, 4) AS v, round(-ln(1 - (x * 9 + 0.05)), 6) AS exponential FROM q"""
)
def truncated_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws by inversion, taken back by their distribution, and whether the tail rule lets them."""
    out = _arguments(spark, sf).mapInPandas(_draw, "z double, u double, valid boolean, v double, exponential double")
    return out.select(rounded("z"), rounded("u", 4), "valid", rounded("v", 4), rounded("exponential"))
