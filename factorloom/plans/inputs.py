"""Matrices derived from the star-schema tables.

``d`` is brands x suppliers, ln(1 + quantity); ``d_sparse`` is parts x suppliers, quantity; ``a`` and ``p`` are surrogate factors (mean
quantity and discount by return flag) that give the analytics deterministic inputs.
They are not posterior factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = """
WITH RECURSIVE lines AS (
  SELECT CAST(substr(p_brand, 7) AS BIGINT) AS i, p_brand AS name, p_type AS type, l_suppkey AS j, l_quantity AS q, l_discount AS disc, l_linenumber AS iter,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT i, j, ln(1 + sum(q)) AS value FROM lines GROUP BY i, j),
a AS (SELECT i, name, k, avg(q) AS mean, stddev_samp(q) AS sd FROM lines GROUP BY i, name, k),
p AS (SELECT j, k, avg(disc) AS mean, stddev_samp(disc) AS sd FROM lines GROUP BY j, k),
sets AS (SELECT b.type AS gene_set, b.name FROM (SELECT type, name, avg(q) AS m FROM lines GROUP BY type, name) b JOIN (SELECT type, avg(q) AS m FROM lines GROUP BY type) t ON b.type = t.type
         WHERE round(b.m, 9) > round(t.m, 9)),
grid AS (SELECT a.i, p.j, sum(a.mean * p.mean) AS m FROM a JOIN p ON a.k = p.k GROUP BY a.i, p.j),
m AS (SELECT i - 1 AS i, CAST(iter - 1 AS BIGINT) AS j, sum(q) AS value FROM lines GROUP BY i, iter),
samples AS (SELECT iter, i AS idx, k, round(avg(q), 6) AS mean FROM lines GROUP BY iter, i, k)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linenumber")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    k = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return item.join(part, item.l_partkey == part.p_partkey).select(
        F.expr("cast(substr(p_brand, 7) as long)").alias("i"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_linenumber").alias("iter"), k.alias("k")
    )


def d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("i", "j").agg(F.log(1 + F.sum("q")).alias("value"))


def d_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return item.groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("value"))


def a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(F.col("i").alias("idx"), "name", "k").agg(F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"))


def p(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = lines(spark, sf_dir).groupBy(F.col("j").alias("idx"), "k").agg(F.avg("disc").alias("mean"), F.stddev_samp("disc").alias("sd"))
    return sold.withColumn("name", F.concat(F.lit("S"), F.col("idx").cast("string")))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part type, the brands that sell more of it a line than the type does on average."""
    by_brand = lines(spark, sf_dir).groupBy("type", "name").agg(F.sum("q").alias("s"), F.count("q").alias("n"))
    of_type = Window.partitionBy("type")
    mean, whole = F.col("s") / F.col("n"), F.sum("s").over(of_type) / F.sum("n").over(of_type)
    return by_brand.withColumn("above", F.round(mean, 9) > F.round(whole, 9)).where("above").select(F.col("type").alias("gene_set"), "name")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("iter", F.col("i").alias("idx"), "k").agg(F.round(F.avg("q"), 6).alias("mean"))


def m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of brands x line numbers, from 0: quantities."""
    by = lines(spark, sf_dir).groupBy("i", "iter").agg(F.sum("q").alias("value"))
    return by.select((F.col("i") - 1).alias("i"), (F.col("iter") - 1).cast("long").alias("j"), "value")


def zero_based(cell: DataFrame) -> DataFrame:
    return cell.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "value")
