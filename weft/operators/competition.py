"""Window features of scored pairs (q, p, ...): how a pair stands among the candidates of its q and of its p.

All features of one partitioning share one window, so each call shuffles once by q and once by p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank(col: str, part: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*part).orderBy(F.desc_nulls_last(col))).cast("long")


def _second(col: str, part: list[str]) -> Column:
    """Second greatest of a group; 0 for a group of one."""
    w = Window.partitionBy(*part).orderBy(F.desc_nulls_last(col)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.nth_value(col, 2).over(w), F.lit(0.0))


def context_features(pairs: DataFrame, cols: tuple[str, ...] = ("name_cos", "addr_cos", "comb"), joint: str = "comb") -> DataFrame:
    """Group sizes, rank and gap to the greatest for each score within q and within p, and the second best of p."""
    for side in ("q", "p"):
        w = Window.partitionBy(side)
        new = {f"{side}_n": F.count("*").over(w)}
        for c in cols:
            new |= {f"{side}_rank_{c}": _rank(c, [side]), f"{side}_gap_{c}": F.max(c).over(w) - F.col(c)}
        if side == "p":
            new[f"p_second_{joint}"] = _second(joint, ["p"])
        pairs = pairs.withColumns(new)
    return pairs


def prob_features(pairs: DataFrame, prob: str = "prob", strong: float = 0.5) -> DataFrame:
    """The eleven competition features of a probability within q, p and (q, src)."""
    hit = F.sum((F.col(prob) > strong).cast("long"))
    for side in ("q", "p"):
        w = Window.partitionBy(side)
        new = {f"{side}_rank": _rank(prob, [side]), f"{side}_gap": F.max(prob).over(w) - F.col(prob), f"{side}_strong": hit.over(w), f"{side}_second": _second(prob, [side])}
        if side == "q":
            new |= {"q_sum": F.sum(prob).over(w), "q_src_rank": _rank(prob, ["q", "src"])}
        pairs = pairs.withColumns(new)
    return pairs


def scored_features(pairs: DataFrame, score: str = "ce", base: str = "prob2") -> DataFrame:
    """Rank and gap of a sparse score among the pairs that have it; null where it is missing."""
    has = F.col(score).isNotNull()
    out = pairs.withColumn("_has", has)
    for side in ("q", "p"):
        w = Window.partitionBy(side, "_has")
        out = out.withColumns({f"{score}_{side}_rank": F.when(has, F.rank().over(w.orderBy(F.desc(score))).cast("long")), f"{score}_{side}_gap": F.when(has, F.max(score).over(w) - F.col(score))})
    return out.withColumns({f"{score}_scored": has.cast("long"), f"{score}_diff": F.col(score) - F.col(base)}).drop("_has")


def stack_context(pairs: DataFrame, cols: tuple[str, ...] = ("prob", "ce", "ce8")) -> DataFrame:
    """Rank, gap, sum and second best within q, rank and gap within p, for several scores (nulls rank last)."""
    for side in ("q", "p"):
        w, new = Window.partitionBy(side), {}
        for c in cols:
            new |= {f"{c}_{side}_rank": F.when(F.col(c).isNotNull(), _rank(c, [side])), f"{c}_{side}_gap": F.max(c).over(w) - F.col(c)}
            if side == "q":
                new |= {f"{c}_q_sum": F.sum(c).over(w), f"{c}_q_second": _second(c, ["q"])}
        pairs = pairs.withColumns(new)
    return pairs


def group_sizes(pairs: DataFrame) -> DataFrame:
    """Sizes of q, p and (q, src) groups and differences of the scores."""
    size = lambda *c: F.count("*").over(Window.partitionBy(*c))
    return pairs.withColumns({"n_q": size("q"), "n_p": size("p"), "n_qs": size("q", "src"), "ce8_ce": F.col("ce8") - F.col("ce"), "ce8_prob": F.col("ce8") - F.col("prob"), "ce_prob": F.col("ce") - F.col("prob")})


def position(pairs: DataFrame, part: list[str], score: str, name: str = "rk") -> DataFrame:
    """Row number within a group, greatest score first, ties by p."""
    return pairs.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(F.desc_nulls_last(score), "p")).cast("long"))


def top_k(pairs: DataFrame, part: list[str], score: str, k: int) -> DataFrame:
    return position(pairs, part, score, "_rk").where(F.col("_rk") <= k).drop("_rk")


def mix(*cols: Column, seed: int = 0) -> Column:
    """A hash in 0..999,982 from whole-number arithmetic alone, so that other engines can repeat it."""
    h = F.lit(seed % 999983).cast("long")
    for c in cols:
        h = F.pmod(h * 48271 + F.pmod(c.cast("long"), F.lit(999983)) * 69621 + 12345, F.lit(999983))
    return F.pmod(h * 48271 + 11, F.lit(999983))


def random_k(pairs: DataFrame, part: list[str], k: int, seed: int = 0) -> DataFrame:
    """k pairs of each group, in the order of a fixed hash."""
    w = Window.partitionBy(*part).orderBy(mix(F.col("q"), F.col("p"), seed=seed), "q", "p")
    return pairs.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def shared_keys(records: DataFrame, keys: list[str]) -> DataFrame:
    """Flags of records whose (country, key) another record has too.

    Keys are counted with partial sums and only the shared ones are joined back: a blank address that a third of all
    records have is one row there, and AQE may split its side of the join.
    """
    for k in keys:
        many = records.groupBy("country", k).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("country").alias("_c"), F.col(k).alias("_k"), F.lit(1).cast("long").alias(f"{k}_shared"))
        records = records.join(many, records["country"].eqNullSafe(many["_c"]) & records[k].eqNullSafe(many["_k"]), "left").drop("_c", "_k").na.fill(0, [f"{k}_shared"])
    return records
