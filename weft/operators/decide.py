"""From scored pairs (q, p, src, prob) to selected pairs: one owner a record, then a rule.

Ties are settled by id: of equal owners the smallest q, of equal candidates the smallest p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_best(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """Each p keeps its most probable q."""
    w = Window.partitionBy("p").orderBy(F.desc(prob), "q")
    return pairs.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def threshold(best: DataFrame, cut: float, prob: str = "prob") -> DataFrame:
    return best.where(F.col(prob) >= cut)


def threshold_src(best: DataFrame, two: float, three: float) -> DataFrame:
    return best.where(F.col("prob") >= F.when(F.col("src") == 2, two).otherwise(three))


def expected_f(best: DataFrame, alpha: float = 0.0, floor: float = 0.05) -> DataFrame:
    """Per q the prefix, by probability, of greatest expected F0.5; nothing where predicting nothing is as good.

    One shuffle by q: the running sums, the total, the best prefix and the empty set's value share its sort.
    """
    d = best.where(F.col("prob") >= floor)
    run = Window.partitionBy("q").orderBy(F.desc("prob"), "p").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("q").orderBy(F.desc("prob"), "p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"j": F.count("*").over(run), "tp": F.sum("prob").over(run), "t": F.sum("prob").over(whole) + alpha, "f0": F.exp(F.sum(F.log1p(-F.least("prob", F.lit(0.999999)))).over(whole) - alpha)})
    # rounded before comparing: sums differ in their last bits from engine to engine
    d = d.withColumn("f", F.round(1.25 * F.col("tp") / (1.25 * F.col("tp") + 0.25 * (F.col("t") - F.col("tp")) + (F.col("j") - F.col("tp"))), 9))
    d = d.withColumns({"best_f": F.max("f").over(whole)})
    d = d.withColumn("best_j", F.min(F.when(F.col("f") == F.col("best_f"), F.col("j"))).over(whole))
    return d.where((F.col("best_f") > F.round("f0", 9)) & (F.col("j") <= F.col("best_j"))).select(*best.columns)


def decide(best: DataFrame, rule: tuple) -> DataFrame:
    """rule: ("thr", cut), ("src", cut 2, cut 3) or ("expf", alpha)."""
    return {"thr": threshold, "src": threshold_src, "expf": expected_f}[rule[0]](best, *rule[1:])


def country_rules(pairs: DataFrame, rules: DataFrame, default: float) -> DataFrame:
    """Probabilities scaled by country (within 0..1), one owner, then the country's threshold. rules: country, scale, cut."""
    scaled = pairs.join(F.broadcast(rules), "country", "left").withColumn("prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob") * F.coalesce("scale", F.lit(1.0)))))
    return assign_best(scaled).where(F.col("prob") >= F.coalesce("cut", F.lit(default))).drop("scale", "cut")


def rescue_empty(best: DataFrame, chosen: DataFrame, low: float) -> DataFrame:
    """q without a selected pair get their best one, if at least `low`."""
    w = Window.partitionBy("q").orderBy(F.desc("prob"), "p")
    first = best.join(chosen.select("q").distinct(), "q", "left_anti").withColumn("_rk", F.row_number().over(w)).where((F.col("_rk") == 1) & (F.col("prob") >= low)).drop("_rk")
    return chosen.unionByName(first.select(*chosen.columns))


def drop_ambiguous(chosen: DataFrame, records: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs go whose pool address is empty while another record of the country has the same name.

    Names are counted with partial sums, and only shared ones are joined back, so a common name never fills one task.
    """
    shared = records.groupBy("country", "name_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("country").alias("_c"), F.col("name_key").alias("_k"))
    left = records.join(shared, records["country"].eqNullSafe(shared["_c"]) & records["name_key"].eqNullSafe(shared["_k"]), "left_semi").select(F.col("id").alias("q"))
    right = pool.where(F.col("addr_empty") == 1).select(F.col("id").alias("p"))
    bad = chosen.select("q", "p").join(left, "q", "left_semi").join(right, "p", "left_semi")
    return chosen.join(bad, ["q", "p"], "left_anti")


def post_filter(chosen: DataFrame, records: DataFrame, pool: DataFrame, countries: list[str], alike: Column, least: float, mode: str = "either", shared_cut: float | None = None) -> DataFrame:
    """At shared addresses of the listed countries only pairs with names alike stay. alike: over name_a, name_b."""
    here = records.where("addr_norm <> ''").groupBy("country", "addr_norm").agg(F.count("*").alias("_n"))
    a = records.join(here, ["country", "addr_norm"], "left").select(F.col("id").alias("q"), "country", F.col("name_key").alias("name_a"), (F.coalesce("_n", F.lit(0)) > 1).alias("_s1"))
    b = pool.join(here, ["country", "addr_norm"], "left").select(F.col("id").alias("p"), F.col("name_key").alias("name_b"), (F.coalesce("_n", F.lit(0)) > 1).alias("_s2"))
    d = chosen.join(a, "q").join(b, "p")
    hit = {"either": F.col("_s1") | F.col("_s2"), "s1": F.col("_s1"), "pool": F.col("_s2")}[mode] & F.col("country").isin(countries)
    bad = alike < least
    if shared_cut is not None:
        bad = bad | (F.coalesce("prob", F.lit(0.0)) < shared_cut)
    return d.where(~(hit & bad)).select(*chosen.columns)


def completion(best: DataFrame, cut: float, low: float, least: float) -> DataFrame:
    """Rejected pairs of q that lack a match in the pair's source while having one in the other; best of (q, src), >= least."""
    chosen = best.where(F.col("prob") >= cut)
    have = chosen.groupBy("q").agg(F.max((F.col("src") == 2).cast("long")).alias("h2"), F.max((F.col("src") == 3).cast("long")).alias("h3"))
    w = Window.partitionBy("q", "src").orderBy(F.desc("prob"), "p")
    cand = best.where((F.col("prob") < cut) & (F.col("prob") >= low)).withColumn("_rk", F.row_number().over(w)).join(have, "q")
    need = F.when(F.col("src") == 2, (F.col("h3") == 1) & (F.col("h2") == 0)).otherwise((F.col("h2") == 1) & (F.col("h3") == 0))
    return chosen.unionByName(cand.where(need & (F.col("_rk") == 1) & (F.col("prob") >= least)).select(*best.columns))


def group_threshold(best: DataFrame, flag: str, shared: float, unique: float) -> DataFrame:
    return best.where(F.col("prob") >= F.when(F.col(flag) == 1, shared).otherwise(unique))


def siblings(best: DataFrame, pool: DataFrame, alike, cut: float, low: float, least: float, prob_least: float, addr_least: float | None = None) -> DataFrame:
    """Rejected pairs (low <= prob < cut) that resemble a record their entity has already: name by alike(a, b) >= least and,
    if asked, address too. pool: id, name_key, addr_norm; empty addresses are like none. An entity's chosen records are few,
    so the join by q stays as large as its candidates times those."""
    chosen = best.where(F.col("prob") >= cut)
    rec = lambda s: pool.select(F.col("id").alias("p" if s == "i" else "_p"), F.col("name_key").alias(f"_n{s}"), F.col("addr_norm").alias(f"_a{s}"))
    have = chosen.select("q", F.col("p").alias("_p")).join(rec("j"), "_p")
    cand = best.where((F.col("prob") < cut) & (F.col("prob") >= F.greatest(F.lit(low), F.lit(prob_least)))).join(rec("i"), "p")
    both = cand.select("q", "p", "_ni", "_ai").join(have, "q")
    addr = F.when((F.col("_ai") != "") & (F.col("_aj") != ""), alike(F.col("_ai"), F.col("_aj"))).otherwise(0.0)
    g = both.groupBy("q", "p").agg(F.max(F.coalesce(alike(F.col("_ni"), F.col("_nj")), F.lit(0.0))).alias("_s"), F.max(F.coalesce(addr, F.lit(0.0))).alias("_a"))
    ok = g.where((F.col("_s") >= least) & (F.lit(addr_least is None) | (F.col("_a") >= F.lit(addr_least or 0.0)))).select("q", "p")
    return chosen.unionByName(best.join(ok, ["q", "p"], "left_semi"))
