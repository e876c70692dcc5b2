"""Blends, overlays and votes over runs of scored or selected pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def blend(pairs: DataFrame, other: DataFrame, weight: float, prob: str = "prob", ext: str = "p_ext") -> DataFrame:
    """(1 - weight) * prob + weight * ext where ext is there, else prob."""
    return pairs.join(other, ["q", "p"], "left").withColumn(prob, F.coalesce((1 - weight) * F.col(prob) + weight * F.col(ext), F.col(prob))).drop(ext)


def mean_of_available(cols: list[str]) -> Column:
    """Row mean that skips nulls; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    return F.try_divide(total, reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols]))


def merge_scores(runs: list[DataFrame], names: list[str]) -> DataFrame:
    """Full outer join of (q, p, score) runs and the mean of the scores that are there."""
    out = reduce(lambda a, b: a.join(b, ["q", "p"], "full"), runs)
    return out.withColumn("mean", mean_of_available(names))


def fallback(main: DataFrame, other: DataFrame, weight: float = 0.5) -> DataFrame:
    """Mean of two runs' probabilities; the main run's alone where the other lacks the pair."""
    o = other.select("q", "p", F.col("prob").alias("_o"))
    return main.join(o, ["q", "p"], "left").withColumn("prob", (1 - weight) * F.col("prob") + weight * F.coalesce("_o", "prob")).drop("_o")


def select_band(pairs: DataFrame, low: float, high: float, countries: list[str], top: int = 2) -> DataFrame:
    """Pairs with a score in the band, those of the listed countries, and the best few of each q."""
    w = Window.partitionBy("q").orderBy(F.desc("prob"), "p")
    keep = F.col("ce").between(low, high) | F.col("country").isin(countries) | (F.col("_rk") <= top)
    return pairs.withColumn("_rk", F.row_number().over(w)).where(F.coalesce(keep, F.lit(False))).drop("_rk")


def overlay(pairs: DataFrame, corrected: DataFrame) -> DataFrame:
    """The corrector's probability (q, p, pc) inside its band, the base's elsewhere."""
    return pairs.join(corrected, ["q", "p"], "left").withColumn("prob", F.coalesce("pc", "prob")).drop("pc")


def vote(runs: list[DataFrame], ref: int, least: int, candidates: DataFrame) -> DataFrame:
    """Pairs with enough votes (a tie goes with the reference run), one q a p by votes, within the candidates."""
    all_ = reduce(lambda a, b: a.unionByName(b), [r.select("q", "p", F.lit(int(k == ref)).alias("ref")) for k, r in enumerate(runs)])
    n = all_.groupBy("q", "p").agg(F.count("*").alias("votes"), F.max("ref").alias("ref"))
    tie = F.lit(2 * (least - 1) == len(runs)) & (F.col("votes") == least - 1) & (F.col("ref") == 1)
    w = Window.partitionBy("p").orderBy(F.desc("votes"), F.desc("ref"), "q")
    kept = n.where((F.col("votes") >= least) | tie).withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
    return kept.join(candidates.select("q", "p"), ["q", "p"], "left_semi").select("q", "p", "votes")


def without_suspects(voted: DataFrame, trusted: DataFrame, suspect: DataFrame) -> DataFrame:
    """Voted pairs less those that the suspect run adds to the trusted one."""
    added = suspect.select("q", "p").join(trusted.select("q", "p"), ["q", "p"], "left_anti")
    return voted.join(added, ["q", "p"], "left_anti")


def hybrid(a: DataFrame, b: DataFrame, country: DataFrame, from_a: list[str]) -> DataFrame:
    """Pairs of q in the listed countries from run a, of all others from run b."""
    c = country.select("q", F.col("country").isin(from_a).alias("_a"))
    return a.join(c, "q").where("_a").drop("_a").unionByName(b.join(c, "q").where("NOT _a").drop("_a"))


def compare_runs(new: DataFrame, old: DataFrame, ids: DataFrame) -> DataFrame:
    """By country: entities, changed lists, pairs added and removed, share of empty lists. ids: q, country."""
    both = new.select("q", "p", F.lit(1).alias("n"), F.lit(0).alias("o")).unionByName(old.select("q", "p", F.lit(0).alias("n"), F.lit(1).alias("o"))).groupBy("q", "p").agg(F.max("n").alias("n"), F.max("o").alias("o"))
    per = both.groupBy("q").agg(F.sum((F.col("n") > F.col("o")).cast("long")).alias("added"), F.sum((F.col("o") > F.col("n")).cast("long")).alias("removed"), F.sum("n").alias("nn"), F.sum("o").alias("no"))
    e = ids.join(per, "q", "left").na.fill(0, ["added", "removed", "nn", "no"])
    return e.groupBy("country").agg(F.count("*").alias("entities"), F.sum(((F.col("added") + F.col("removed")) > 0).cast("long")).alias("changed"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.avg((F.col("nn") == 0).cast("double")).alias("empty_new"), F.avg((F.col("no") == 0).cast("double")).alias("empty_old"))


def vote_histogram(runs: list[DataFrame]) -> DataFrame:
    """How many pairs have how many votes."""
    all_ = reduce(lambda a, b: a.unionByName(b), [r.select("q", "p") for r in runs])
    return all_.groupBy("q", "p").agg(F.count("*").alias("votes")).groupBy("votes").agg(F.count("*").alias("pairs"))


def run_summary(runs: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Of each run: pairs an entity and share of empty entities."""
    n = ids.select(F.count("*").alias("ids"))
    parts = [r.agg(F.count("*").alias("pairs"), F.countDistinct("q").alias("used")).withColumn("run", F.lit(k)) for k, r in runs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).crossJoin(F.broadcast(n)).select("run", "pairs", (F.col("pairs") / F.col("ids")).alias("per_entity"), (1 - F.col("used") / F.col("ids")).alias("empty"))


def pair_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and the differences of two pair sets."""
    n = a.select("q", "p", F.lit(1).alias("w")).distinct().unionByName(b.select("q", "p", F.lit(2).alias("w")).distinct()).groupBy("q", "p").agg(F.sum("w").alias("w"))
    return n.groupBy(F.element_at(F.array(F.lit("only_a"), F.lit("only_b"), F.lit("both")), F.col("w").cast("int")).alias("part")).agg(F.count("*").alias("pairs"))


def blend_sweep(pairs: DataFrame, other: DataFrame, weights: list[float], two: float, three: float, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(weight, macro_f05, touched_f05) of a blend's weights: one owner a record and the thresholds by source for each
    weight, over all entities and over those with a blended pair. The join with the other score is made once."""
    d = pairs.join(other, ["q", "p"], "left")
    every = d.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights]))).withColumn("prob", F.coalesce((1 - F.col("weight")) * F.col("prob") + F.col("weight") * F.col("p_ext"), F.col("prob")))
    w = Window.partitionBy("weight", "p").orderBy(F.desc("prob"), "q")
    owned = every.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").where(F.col("prob") >= F.when(F.col("src") == 2, two).otherwise(three))
    hit = owned.join(truth.select("q", "p", F.lit(1).alias("_t")).distinct(), ["q", "p"], "left")
    per = hit.groupBy("weight", "q").agg(F.sum(F.coalesce("_t", F.lit(0))).alias("tp"), F.count("*").alias("npred"))
    ntrue = ids.select("q").join(truth.groupBy("q").agg(F.countDistinct("p").alias("ntrue")), "q", "left").na.fill(0)
    touched = d.where("p_ext IS NOT NULL").select("q").distinct().withColumn("_touched", F.lit(1.0))
    base = ntrue.join(touched, "q", "left").na.fill(0.0, ["_touched"]).withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights])))
    f = metrics.f05(F.col("tp"), F.col("npred"), F.col("ntrue"))
    return base.join(per, ["weight", "q"], "left").na.fill(0, ["tp", "npred"]).groupBy("weight").agg(F.avg(f).alias("macro_f05"), F.avg(F.when(F.col("_touched") == 1, f)).alias("touched_f05"))


def disagreement(runs: dict[str, DataFrame], ref: str, ids: DataFrame) -> DataFrame:
    """(run, country, entities, differ, added, removed) of each run against the reference run. ids: q, country."""
    old = runs[ref].select("q", "p", F.lit(1).alias("_o"))
    parts = []
    for name, run in runs.items():
        if name == ref:
            continue
        both = run.select("q", "p", F.lit(1).alias("_n")).join(old, ["q", "p"], "full")
        per = both.groupBy("q").agg(F.count_if(F.col("_o").isNull()).alias("a"), F.count_if(F.col("_n").isNull()).alias("r"))
        e = ids.join(per, "q", "left").na.fill(0, ["a", "r"])
        parts.append(e.groupBy(F.lit(name).alias("run"), "country").agg(F.count("*").alias("entities"), F.count_if(F.col("a") + F.col("r") > 0).alias("differ"), F.sum("a").alias("added"), F.sum("r").alias("removed")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def contested(runs: list[DataFrame], ids: DataFrame) -> DataFrame:
    """(country, pairs, contested): pairs of any run, and those that not all runs have."""
    all_ = reduce(lambda a, b: a.unionByName(b), [r.select("q", "p").distinct() for r in runs])
    n = all_.groupBy("q", "p").agg(F.count("*").alias("votes")).join(ids, "q")
    return n.groupBy("country").agg(F.count("*").alias("pairs"), F.count_if(F.col("votes") < len(runs)).alias("contested"))


def pair_sets_by(a: DataFrame, b: DataFrame, ids: DataFrame, col: str = "country") -> DataFrame:
    """(country, only_a, only_b, both) of two pair sets."""
    n = a.select("q", "p", F.lit(1).alias("w")).distinct().unionByName(b.select("q", "p", F.lit(2).alias("w")).distinct()).groupBy("q", "p").agg(F.sum("w").alias("w"))
    return n.join(ids, "q").groupBy(col).agg(*[F.count_if(F.col("w") == k).alias(name) for k, name in ((1, "only_a"), (2, "only_b"), (3, "both"))])
