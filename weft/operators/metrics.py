"""Metrics over selected pairs (q, p), true pairs (q, p) and an id list: macro F0.5, losses, ceilings, ranking scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(tp: Column, npred: Column, ntrue: Column) -> Column:
    """F0.5 of one entity: both empty 1, one empty 0, nothing right 0."""
    p, r = F.try_divide(tp.cast("double"), npred), F.try_divide(tp.cast("double"), ntrue)
    return F.when((npred == 0) & (ntrue == 0), 1.0).when((npred == 0) | (ntrue == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_counts(chosen: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """q, tp, npred, ntrue for every id, also those without rows. Aggregated before the join with the ids."""
    both = chosen.select("q", "p", F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(truth.select("q", "p", F.lit(0).alias("c"), F.lit(1).alias("t")))
    pair = both.groupBy("q", "p").agg(F.max("c").alias("c"), F.max("t").alias("t"))
    n = pair.groupBy("q").agg(F.sum(F.col("c") * F.col("t")).alias("tp"), F.sum("c").alias("npred"), F.sum("t").alias("ntrue"))
    return ids.select("q").join(n, "q", "left").na.fill(0)


def evaluate(chosen: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """macro F0.5, mean precision over predicting and mean recall over true entities, micro precision and recall."""
    n = entity_counts(chosen, truth, ids).withColumn("f", f05(F.col("tp"), F.col("npred"), F.col("ntrue")))
    return n.agg(
        F.avg("f").alias("macro_f05"),
        F.avg(F.when(F.col("npred") > 0, F.col("tp") / F.col("npred"))).alias("mean_precision"),
        F.avg(F.when(F.col("ntrue") > 0, F.col("tp") / F.col("ntrue"))).alias("mean_recall"),
        (F.sum("tp") / F.greatest(F.lit(1), F.sum("npred"))).alias("micro_precision"),
        (F.sum("tp") / F.greatest(F.lit(1), F.sum("ntrue"))).alias("micro_recall"),
        F.sum("tp").alias("tp"),
        F.count("*").alias("n"),
    )


def threshold_counts(best: DataFrame, truth: DataFrame, ids: DataFrame, grid: list[float]) -> DataFrame:
    """For every id: ntrue, and by source (2, 3) arrays of how many pairs, and true ones, reach each threshold of the grid.

    One aggregation by q, whatever the grid: settings are tried on these arrays, not on pairs.
    """
    hit = best.join(truth.select("q", "p", F.lit(1).alias("_true")).distinct(), ["q", "p"], "left")
    cell = lambda g, s, c: F.sum(F.when((F.col("src") == s) & (F.col("prob") >= g), c).otherwise(0))
    one, true = F.lit(1), F.coalesce("_true", F.lit(0))
    arrays = [F.array(*[cell(g, s, c) for g in grid]).alias(f"{n}{s}") for s in (2, 3) for n, c in (("n", one), ("tp", true))]
    none = F.array(*[F.lit(0).cast("long")] * len(grid))
    ntrue = truth.groupBy("q").agg(F.countDistinct("p").alias("ntrue"))
    out = ids.join(hit.groupBy("q").agg(*arrays), "q", "left").join(ntrue, "q", "left").na.fill(0, ["ntrue"])
    return out.withColumns({c: F.coalesce(c, none) for c in ("n2", "tp2", "n3", "tp3")})


def surface(counts: DataFrame, settings: list[tuple[int, int]], by: list[str] = ()) -> DataFrame:
    """(by, i, j, macro_f05) of each setting: the grid's threshold i for source 2 and j for source 3.

    Settings are exploded beside their sums, so they are added up before anything is shuffled.
    """
    codes = F.split(F.lit(",".join(str(1000 * i + j) for i, j in settings)), ",")  # one constant, however many settings
    x = counts.withColumn("_s", F.explode(codes)).withColumn("_s", F.col("_s").cast("int")).withColumn("s", F.struct(F.floor(F.col("_s") / 1000).cast("int").alias("i"), (F.col("_s") % 1000).alias("j")))
    at = lambda c, k: F.element_at(c, F.col(f"s.{k}") + 1)
    f = f05(at("tp2", "i") + at("tp3", "j"), at("n2", "i") + at("n3", "j"), F.col("ntrue"))
    return x.select(*by, F.col("s.i").alias("i"), F.col("s.j").alias("j"), f.alias("f")).groupBy(*by, "i", "j").agg(F.round(F.avg("f"), 9).alias("macro_f05"))


def best_setting(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """The setting of greatest score of each group; ties go to the smaller thresholds."""
    w = Window.partitionBy(*by).orderBy(F.desc("macro_f05"), "i", "j")
    return table.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def descend(table: list[tuple[int, int, float]], start: int, rounds: int = 2) -> tuple[int, int]:
    """Coordinate descent over a surface's rows (i, j, score) from (start, start): best i, then best j, `rounds` times."""
    score = {(i, j): f for i, j, f in table}
    size = sorted({i for i, _ in score})
    i = j = start
    for _ in range(rounds):
        i = max(size, key=lambda k: (score[k, j], -k))
        j = max(size, key=lambda k: (score[i, k], -k))
    return i, j


def cross_checked(gains: DataFrame) -> DataFrame:
    """Whether a rule may be used: the setting that is best on either half of the entities must gain on the other.

    gains: setting, gain_all, gain_a, gain_b. Returns setting (the best on all; null if refused) and accepted.
    """
    first = lambda c: F.max_by(F.struct("setting", "gain_a", "gain_b"), F.struct(F.col(c), -F.col("setting")))
    x = gains.agg(first("gain_a").alias("a"), first("gain_b").alias("b"), first("gain_all").alias("all"))
    ok = (F.col("a.gain_b") > 0) & (F.col("b.gain_a") > 0)
    return x.select(F.when(ok, F.col("all.setting")).alias("setting"), ok.cast("long").alias("accepted"), F.col("a.setting").alias("best_a"), F.col("b.setting").alias("best_b"))


def rescue_gains(best: DataFrame, chosen: DataFrame, truth: DataFrame, ids: DataFrame, grid: list[float]) -> DataFrame:
    """(setting, added, gain_all, gain_a, gain_b) of rescuing empty entities from each threshold on. ids: q, half.

    Only an entity's best pair can be added, so each entity gains at most once; gains are summed by threshold.
    """
    w = Window.partitionBy("q").orderBy(F.desc("prob"), "p")
    first = best.join(chosen.select("q").distinct(), "q", "left_anti").withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
    hit = first.join(truth.select("q", "p", F.lit(1).alias("tp")).distinct(), ["q", "p"], "left").na.fill(0, ["tp"])
    n = truth.groupBy("q").agg(F.countDistinct("p").alias("ntrue"))
    one = hit.join(n, "q", "left").na.fill(0, ["ntrue"]).withColumn("d", f05(F.col("tp"), F.lit(1), F.col("ntrue")) - (F.col("ntrue") == 0).cast("double"))
    every = one.join(ids, "q").withColumn("setting", F.explode(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.col("prob") >= g)))
    half = lambda k: F.sum(F.when(F.col("half") == k, F.col("d")).otherwise(0.0))
    gain = every.groupBy("setting").agg(F.count("*").alias("added"), F.sum("d").alias("d"), half(0).alias("a"), half(1).alias("b"))
    size = ids.agg(F.count("*").alias("n"), F.count_if(F.col("half") == 0).alias("na"), F.count_if(F.col("half") == 1).alias("nb"))
    spark = best.sparkSession
    table = spark.createDataFrame([(float(g),) for g in grid], "setting double").join(F.broadcast(gain), "setting", "left").na.fill(0)
    share = lambda d, k: F.round(F.coalesce(F.try_divide(F.col(d), F.col(k)), F.lit(0.0)), 9)
    return table.crossJoin(F.broadcast(size)).select("setting", "added", share("d", "n").alias("gain_all"), share("a", "na").alias("gain_a"), share("b", "nb").alias("gain_b"))


def coverage(pairs: DataFrame, rules: list[tuple[float, int]], score: str = "prob2", label: str = "y") -> DataFrame:
    """(least, most, covered, per_entity): of each rule (score >= least, rank in q <= most) the share of true pairs it
    keeps and the pairs it leaves an entity. The ranks are made once, the rules are conditional sums."""
    w = Window.partitionBy("q").orderBy(F.desc(score), "p")
    r = pairs.withColumn("_rk", F.row_number().over(w))
    keep = lambda rule: (F.col(score) >= rule[0]) & (F.col("_rk") <= rule[1])
    rows = F.array(*[F.struct(F.lit(float(x[0])).alias("least"), F.lit(x[1]).cast("long").alias("most"), F.sum(F.when(keep(x), F.col(label)).otherwise(0)).alias("t"), F.count_if(keep(x)).alias("n")) for x in rules])
    one = r.agg(rows.alias("r"), F.sum(label).alias("true"), F.countDistinct("q").alias("q"))
    return one.select(F.explode("r").alias("r"), "true", "q").select("r.least", "r.most", F.try_divide("r.t", "true").alias("covered"), F.try_divide("r.n", "q").alias("per_entity"))


def loss_table(pairs: DataFrame, best: DataFrame, truth: DataFrame, cut: float) -> DataFrame:
    """True pairs by what became of them: not a candidate, lost to another q, below the threshold, found."""
    t = truth.select("q", "p").join(pairs.select("q", "p", F.lit(1).alias("c")), ["q", "p"], "left").join(best.select("q", "p", F.col("prob").alias("b")), ["q", "p"], "left")
    fate = F.when(F.col("c").isNull(), "not a candidate").when(F.col("b").isNull(), "lost to another").when(F.col("b") < cut, "below threshold").otherwise("found")
    n = t.groupBy(fate.alias("fate")).agg(F.count("*").alias("pairs"))
    return n.crossJoin(F.broadcast(truth.agg(F.count("*").alias("total")))).select("fate", "pairs", (F.col("pairs") / F.col("total")).alias("share"))


def ceilings(best: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Macro F0.5 of all true candidates, and of the best prefix of each entity in hindsight; entities with no true candidate."""
    hit = best.join(truth.select("q", "p", F.lit(1).alias("t")), ["q", "p"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    ntrue = ids.select("q").join(truth.groupBy("q").agg(F.countDistinct("p").alias("ntrue")), "q", "left").na.fill(0)
    run = Window.partitionBy("q").orderBy(F.desc("prob"), "p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hit.withColumns({"tp": F.sum("t").over(run), "j": F.count("*").over(run)}).join(ntrue, "q")
    top = ranked.groupBy("q").agg(F.max(f05(F.col("tp"), F.col("j"), F.col("ntrue"))).alias("prefix"), F.max("tp").alias("found"))
    e = ntrue.join(top, "q", "left").na.fill(0)
    none = (F.col("ntrue") == 0).cast("double")
    return e.agg(F.avg(f05(F.col("found"), F.col("found"), F.col("ntrue"))).alias("oracle_f05"), F.avg(F.greatest("prefix", none)).alias("prefix_f05"), F.sum(((F.col("ntrue") > 0) & (F.col("found") == 0)).cast("long")).alias("blocked_out"))


def group_loss(counts: DataFrame, by: list[str]) -> DataFrame:
    """Loss of macro F0.5 by group and its share in all. counts: tp, npred, ntrue and the group's columns."""
    n = counts.withColumn("loss", 1 - f05(F.col("tp"), F.col("npred"), F.col("ntrue"))).groupBy(*by).agg(F.count("*").alias("entities"), F.sum("loss").alias("loss"))
    total = n.agg(F.sum("loss").alias("_all"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("loss", "_all")).drop("_all")


def _before(h: DataFrame, col: str, down: bool) -> DataFrame:
    """Adds `before`: the sum of col over smaller (or greater) scores s, in two levels, so that no task sees all of them.

    The range of the scores is cut into 4,096 steps; the steps' sums run in one small window, the scores of a step in another.
    """
    ends = h.agg(F.min("s").alias("_low"), F.max("s").alias("_high"))
    step = h.crossJoin(F.broadcast(ends)).withColumn("_step", F.floor(F.coalesce(F.try_divide(F.col("s") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * 4096)).drop("_low", "_high")
    key = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    whole = step.groupBy("_step").agg(F.sum(col).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(Window.orderBy(key("_step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_n")
    inside = F.coalesce(F.sum(col).over(Window.partitionBy("_step").orderBy(key("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return step.withColumn("_in", inside).join(F.broadcast(whole), "_step").withColumn("before", F.col("_above") + F.col("_in")).drop("_above", "_in", "_step")


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums with average ranks."""
    h = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    r = _before(h, "neg", False)
    return r.agg(F.try_divide(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over score values, from the greatest, of precision times the gain in recall."""
    h = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    r = _before(_before(h, "pos", True).withColumnRenamed("before", "tp0"), "n", True)
    return r.agg(F.try_divide(F.sum(F.col("pos") * (F.col("tp0") + F.col("pos")) / (F.col("before") + F.col("n"))), F.sum("pos")).alias("ap"))


def log_loss(scored: DataFrame, score: str, label: str, eps: float = 1e-6) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score)))
    return scored.where(F.col(score).isNotNull()).agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"), F.avg((F.col(label) == (F.col(score) >= 0.5).cast("int")).cast("double")).alias("accuracy"))


def right_closed(c: Column, edges: list[float]) -> Column:
    """Bin number of c in (edge, next edge]; null outside."""
    return reduce(lambda w, k: w.when((c > edges[k]) & (c <= edges[k + 1]), k), range(len(edges) - 1), F.when(F.lit(False), -1))


def binned_rate(df: DataFrame, col: str, edges: list[float], label: str, by: list[str]) -> DataFrame:
    """Size and mean label by bin and group."""
    return df.withColumn("bin", right_closed(F.col(col), edges).cast("long")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def at_half(scored: DataFrame, scores: list[str], label: str, by: list[str] = ()) -> DataFrame:
    """(by, score, n, accuracy, precision, recall) of each score cut at 0.5; rows without the score are left out."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("v")) for c in scores]))
    x = scored.select(*by, F.col(label).cast("double").alias("y"), rows.alias("r")).where("r.v IS NOT NULL")
    yes = F.col("r.v") >= 0.5
    return x.groupBy(*by, F.col("r.score").alias("score")).agg(F.count("*").alias("n"), F.avg((yes.cast("double") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.when(yes, F.col("y"))).alias("precision"), F.avg(F.when(F.col("y") == 1, yes.cast("double"))).alias("recall"))


def hold_out(groups: DataFrame, gid: str, score: str, label: str, eps: float = 1e-6) -> DataFrame:
    """Log-loss, share of groups with a positive whose best pair is one, mean scores, and errors at 0.5."""
    y, s = F.col(label).cast("double"), F.col(score)
    top = groups.groupBy(gid).agg(F.max(label).alias("_any"), F.max_by(y, F.struct(s, -F.col("p"))).alias("_top")).where("_any > 0.5").agg(F.avg("_top").alias("top1"))
    e = groups.agg(F.count("*").alias("rows"), F.avg(-(y * F.log(s + eps) + (1 - y) * F.log(1 - s + eps))).alias("logloss"), F.avg(F.when(y > 0.5, s)).alias("mean_pos"), F.avg(F.when(y < 0.5, s)).alias("mean_neg"), F.avg(F.when(y > 0.5, (s < 0.5).cast("double"))).alias("pos_below"), F.avg(F.when(y < 0.5, (s > 0.5).cast("double"))).alias("neg_above"))
    return e.crossJoin(F.broadcast(top))


def binned_rate2(df: DataFrame, one: str, edges: list[float], two: str, edges2: list[float], label: str) -> DataFrame:
    """Size and mean label by the bins of two columns."""
    x = df.withColumns({"bin": right_closed(F.col(one), edges).cast("long"), "bin2": right_closed(F.col(two), edges2).cast("long")})
    return x.where("bin IS NOT NULL AND bin2 IS NOT NULL").groupBy("bin", "bin2").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def dense_ids(ids: DataFrame, col: str, name: str = "gid") -> DataFrame:
    """Adds the place of each distinct value of a whole-number column in ascending order, from 0, without a global sort:
    4,096 steps of the range are counted first, then values are ranked within their step."""
    d = ids.select(col).distinct()
    ends = d.agg(F.min(col).alias("_low"), F.max(col).alias("_high"))
    width = F.floor((F.col("_high") - F.col("_low")) / 4096) + 1
    step = d.crossJoin(F.broadcast(ends)).withColumn("_step", F.floor((F.col(col) - F.col("_low")) / width)).drop("_low", "_high")
    whole = step.groupBy("_step").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_step")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_step").orderBy(col)) - 1
    ranked = step.withColumn("_in", inside).join(F.broadcast(whole), "_step").select(col, (F.col("_before") + F.col("_in")).cast("long").alias(name))
    return ids.join(ranked, col)
