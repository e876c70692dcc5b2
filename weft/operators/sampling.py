"""Deterministic samples, folds and training sets; every draw is a hash of ids, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .competition import mix, random_k, top_k


def uniform(*ids: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from ids."""
    return mix(*ids, seed=seed) / F.lit(999983.0)


def fold(q: Column) -> Column:
    """0 or 1: bit 7 of q * 2654435761, for ids below 2**31."""
    return F.pmod(F.shiftrightunsigned(q.cast("long") * F.lit(2654435761), 7), F.lit(2))


def sample(df: DataFrame, fraction: float, *ids: str, seed: int = 0) -> DataFrame:
    return df.where(uniform(*[F.col(c) for c in ids], seed=seed) < fraction)


def density_sample(a: DataFrame, pool: DataFrame, truth: DataFrame, fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A fraction of the entities, all their true records, and the same fraction of the records nobody owns."""
    kept = sample(a, fraction, "q", seed=seed)
    own = truth.join(kept.select("q"), "q", "left_semi").select("p").distinct()
    free = pool.join(truth.select("p").distinct(), "p", "left_anti")
    return kept, pool.join(own, "p", "left_semi").unionByName(sample(free, fraction, "p", seed=seed + 1))


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("q", "p", F.lit(1).alias("y")).distinct(), ["q", "p"], "left").na.fill(0, ["y"])


def candidates_to_score(pairs: DataFrame, score: str, least: float, k: int) -> DataFrame:
    return top_k(pairs, ["q"], score, k).where(F.col(score) >= least)


def training_pairs(labelled: DataFrame, hard: int = 6, random: int = 2, seed: int = 0) -> DataFrame:
    """All positives, the most probable negatives of each q, and a few random ones of the rest."""
    negative = labelled.where("y = 0")
    h = top_k(negative, ["q"], "prob", hard)
    rest = negative.join(h.select("q", "p"), ["q", "p"], "left_anti")
    return labelled.where("y = 1").unionByName(h).unionByName(random_k(rest, ["q"], random, seed))


def mine_groups(labelled: DataFrame, low: float, high: float, easy: float, most: int, seed: int = 0) -> DataFrame:
    """Whole candidate groups of q with a hard pair (a positive scored low, a negative scored high) or by an easy draw,
    at most `most` pairs each: positives first, then the least certain."""
    hard = ((F.col("y") == 1) & (F.col("ce") < high)) | ((F.col("y") == 0) & (F.col("ce") > low))
    seeds = labelled.where(F.coalesce(hard, F.lit(False)) | (uniform(F.col("q"), seed=seed) < easy)).select("q").distinct()
    w = Window.partitionBy("q").orderBy(F.desc("y"), F.abs(F.coalesce("ce", F.lit(0.0)) - 0.5), "p")
    return labelled.join(seeds, "q", "left_semi").withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= most).drop("_rk")


def pseudo_labels(pairs: DataFrame, chosen: DataFrame, known: DataFrame, per_q: int = 3, top: int = 8) -> DataFrame:
    """Labels for countries without truth: confident selected pairs, and confident rejections, as many at most as the former."""
    new = pairs.join(F.broadcast(known), "country", "left_anti")
    sel = chosen.select("q", "p", F.lit(1).alias("s"))
    d = new.join(sel, ["q", "p"], "left")
    pos = d.where((F.col("s") == 1) & (F.col("prob") >= 0.9) & (F.col("ce") >= 0.9)).select("q", "p", F.lit(1).alias("y"))
    neg = top_k(d, ["q"], "prob", top).where(F.col("s").isNull() & (F.col("prob") <= 0.2) & (F.col("ce").isNull() | (F.col("ce") <= 0.2)))
    neg = random_k(neg, ["q"], per_q).select("q", "p", F.lit(0).alias("y"))
    # the share of negatives to keep is known from two counts; the cut is by hash, not by a global sort
    n = pos.agg(F.count("*").alias("np")).crossJoin(neg.agg(F.count("*").alias("nn")))
    kept = neg.crossJoin(F.broadcast(n)).where(uniform(F.col("q"), F.col("p"), seed=3) < F.least(F.lit(1.0), F.try_divide("np", "nn"))).select("q", "p", "y")
    return pos.unionByName(kept)


def drop_entities(pairs: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Pairs without a share of the entities, as if those had not been there."""
    return pairs.where(uniform(F.col("q"), seed=seed) >= share)
