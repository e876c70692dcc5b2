"""Inputs of the queries: pair, truth and record views over the shared tables, as DataFrames and as DuckDB SQL.

Scores are whole numbers over 101, so both engines hold the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _score(expr: str):
    return F.expr(f"CAST(pmod({expr}, 101) AS DOUBLE) / CAST(101 AS DOUBLE)")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidate pairs (q, p) over lineitem; ce and ce8 are sparse. One aggregation by pair."""
    key = "CAST(l_quantity * 7 + round(l_discount * 100) AS BIGINT) % 101"
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("q"), F.col("l_orderkey").alias("p")).agg(F.min(F.expr("2 + l_linenumber % 2")).cast("long").alias("src"), F.max(F.expr(key)).alias("k"))
    return base.select(
        "q", "p", "src",
        _score("k").alias("prob"),
        _score("k * 3 + q").alias("prob2"),
        F.when(F.expr("(q * 7 + p * 3) % 4 <> 0"), _score("k * 37 + p")).alias("ce"),
        F.when(F.expr("(q + p) % 3 = 0"), _score("k * 53 + q + p")).alias("ce8"),
        _score("k * 29 + q").alias("name_cos"),
        _score("k * 31 + p").alias("addr_cos"),
        F.concat(F.lit("c"), F.expr("q % 4").cast("string")).alias("country"),
    ).withColumn("comb", F.round(0.4 * F.col("name_cos") + 0.6 * F.col("addr_cos"), 9))


PAIRS = """base AS (
  SELECT l_partkey AS q, l_orderkey AS p, CAST(min(2 + l_linenumber % 2) AS BIGINT) AS src,
         max(CAST(l_quantity * 7 + round(l_discount * 100) AS BIGINT) % 101) AS k
  FROM lineitem GROUP BY 1, 2),
pairs AS (
  SELECT q, p, src, (k % 101) / 101::DOUBLE AS prob, ((k * 3 + q) % 101) / 101::DOUBLE AS prob2,
         CASE WHEN (q * 7 + p * 3) % 4 <> 0 THEN ((k * 37 + p) % 101) / 101::DOUBLE END AS ce,
         CASE WHEN (q + p) % 3 = 0 THEN ((k * 53 + q + p) % 101) / 101::DOUBLE END AS ce8,
         ((k * 29 + q) % 101) / 101::DOUBLE AS name_cos, ((k * 31 + p) % 101) / 101::DOUBLE AS addr_cos,
         'c' || (q % 4)::VARCHAR AS country,
         round(0.4::DOUBLE * (((k * 29 + q) % 101) / 101::DOUBLE) + 0.6::DOUBLE * (((k * 31 + p) % 101) / 101::DOUBLE), 9) AS comb
  FROM base)"""
BEST = PAIRS + """,
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY prob DESC, q) = 1)"""


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities: the parts, with a country."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), F.concat(F.lit("c"), F.expr("p_partkey % 4").cast("string")).alias("country"))


IDS = "ids AS (SELECT p_partkey AS q, 'c' || (p_partkey % 4)::VARCHAR AS country FROM part)"


def truth(all_pairs: DataFrame) -> DataFrame:
    """True pairs by a rule on the ids, one owner a p; and some that are no candidates."""
    owned = all_pairs.where("(q * 31 + p * 17) % 5 = 0").groupBy("p").agg(F.min("q").alias("q")).select("q", "p")
    missed = all_pairs.where("p % 97 = 0").groupBy("q").agg((F.min("p") * -1 - 1).alias("p"))
    return owned.unionByName(missed)


TRUTH = """gt AS (
  SELECT min(q) AS q, p FROM pairs WHERE (q * 31 + p * 17) % 5 = 0 GROUP BY p
  UNION ALL SELECT q, -min(p) - 1 AS p FROM pairs WHERE p % 97 = 0 GROUP BY q)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and address records from documents: names are a text's first six words, addresses its source and the next four.

    A record is short by its nature, so the queries over records read these words of each text and no more: what follows
    the tenth word is neither cleaned nor split, which for long texts is most of the time.
    """
    head = F.regexp_extract(F.lower("text"), "^[^{0}]*+((?:[{0}]++[^{0}]*+){{0,9}}[{0}]*+)".format("a-z0-9à-öø-ÿß"), 1)
    clean = F.filter(F.split(F.regexp_replace(head, "[^a-z0-9à-öø-ÿß]+", " "), " "), lambda w: w != "")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", clean.alias("w"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("country"),
        F.when(F.expr("doc_id % 3 = 0"), "a").otherwise("b").alias("side"),
        F.expr("1 + doc_id % 3").alias("src"),
        F.array_join(F.slice("w", 1, 6), " ").alias("name_key"),
        F.when(F.expr("doc_id % 29 = 0"), "").otherwise(F.concat_ws(" ", F.col("source"), F.array_join(F.slice("w", 7, 4), " "))).alias("addr_norm"),
    )


RECORDS = """words AS (
  SELECT doc_id, lang, source, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9à-öø-ÿß]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
records AS (
  SELECT doc_id AS id, lang AS country, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS side, 1 + doc_id % 3 AS src,
         coalesce(array_to_string(w[1:6], ' '), '') AS name_key,
         CASE WHEN doc_id % 29 = 0 THEN '' ELSE source || ' ' || coalesce(array_to_string(w[7:10], ' '), '') END AS addr_norm
  FROM words)"""
