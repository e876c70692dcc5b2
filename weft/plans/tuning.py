"""Queries that search decision rules and weigh runs, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strsim, text
from ..operators import decide, ensemble, metrics, sampling, synth
from ..operators import blocking
from . import queries as Q
from . import views as V
from .queries import query, rounded

GRID = [(400 + 25 * i) / 1000 for i in range(23)]
WIDE = [(40 + 5 * i) / 100 for i in range(12)]
NEAR = [(i, j) for i in range(12) for j in range(12) if abs(i - j) <= 2]


def _all(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Owned pairs, true pairs and entities."""
    pairs = V.pairs(spark, d)
    return decide.assign_best(pairs), V.truth(pairs), V.ids(spark, d)


def _surface(n: int, low: int, step: int, scale: int, where: str = "", by: str = "") -> str:
    """sf: macro F0.5 of each pair of thresholds (i for source 2, j for source 3), by the columns of nt named in by."""
    cols = f"{by}, " if by else ""
    return f"""gr AS (SELECT i::BIGINT AS i, ({low} + {step} * i) / {scale}::DOUBLE AS t FROM range({n}) r(i)),
cn AS (SELECT b.q, src, i, count(*) AS n, count(gt.p) AS tp FROM best b JOIN gr ON prob >= t LEFT JOIN gt ON gt.q = b.q AND gt.p = b.p GROUP BY b.q, src, i),
sf AS (SELECT {cols}g2.i AS i, g3.i AS j, round(avg({Q.f05('(coalesce(a.tp, 0) + coalesce(b.tp, 0))', '(coalesce(a.n, 0) + coalesce(b.n, 0))', 'ntrue')}), 9) AS m
  FROM gr g2 CROSS JOIN gr g3 CROSS JOIN nt LEFT JOIN cn a ON a.q = nt.q AND a.src = 2 AND a.i = g2.i LEFT JOIN cn b ON b.q = nt.q AND b.src = 3 AND b.i = g3.i {where} GROUP BY {cols}g2.i, g3.i)"""


_NT = "nt AS (SELECT ids.q, country, q % 3 = 0 AS flag, coalesce(c, 0) AS ntrue FROM ids LEFT JOIN (SELECT q, count(DISTINCT p) AS c FROM gt GROUP BY q) USING (q))"


def _expf(alpha: float, k: int) -> str:
    """Macro F0.5 of the expected-F0.5 rule, as CTE x{k}."""
    named = re.sub(r"\b(ed|ee|eg|eh|chosen)\b", rf"\g<1>{k}", Q._expected(alpha))
    return f"""{named}, n{k} AS (SELECT s.q, count(gt.p) AS tp, count(*) AS np FROM chosen{k} s LEFT JOIN gt ON gt.q = s.q AND gt.p = s.p GROUP BY s.q),
x{k} AS (SELECT avg({Q.f05('coalesce(tp, 0)', 'coalesce(np, 0)', 'ntrue')}) AS m FROM nt LEFT JOIN n{k} USING (q))"""


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, {_surface(23, 400, 25, 1000)}, {_expf(0.0, 1)}, {_expf(0.1, 2)}, {_expf(0.2, 3)},
t0 AS (SELECT i AS t FROM sf WHERE i = j ORDER BY m DESC, i LIMIT 1), a1 AS (SELECT i AS t FROM sf, t0 WHERE j = t0.t ORDER BY m DESC, i LIMIT 1), b1 AS (SELECT j AS t FROM sf, a1 WHERE i = a1.t ORDER BY m DESC, j LIMIT 1),
a2 AS (SELECT i AS t FROM sf, b1 WHERE j = b1.t ORDER BY m DESC, i LIMIT 1), b2 AS (SELECT j AS t FROM sf, a2 WHERE i = a2.t ORDER BY m DESC, j LIMIT 1)
SELECT 'thr' AS rule, (400 + 25 * i) / 1000::DOUBLE AS p1, (400 + 25 * i) / 1000::DOUBLE AS p2, round(m, 6) AS macro_f05 FROM sf WHERE i = j
UNION ALL SELECT 'expf', 0.0::DOUBLE, 0.0::DOUBLE, round(m, 6) FROM x1 UNION ALL SELECT 'expf', 0.1::DOUBLE, 0.1::DOUBLE, round(m, 6) FROM x2 UNION ALL SELECT 'expf', 0.2::DOUBLE, 0.2::DOUBLE, round(m, 6) FROM x3
UNION ALL SELECT 'src', (400 + 25 * i) / 1000::DOUBLE, (400 + 25 * j) / 1000::DOUBLE, round(m, 6) FROM sf, a2, b2 WHERE i = a2.t AND j = b2.t""")
def search_rules(spark, d):
    """Thresholds, expected-F0.5 cuts and coordinate descent over both sources' thresholds."""
    best, truth, ids = _all(spark, d)
    counts = metrics.threshold_counts(best, truth, ids, GRID)
    table = [(r.i, r.j, r.macro_f05) for r in metrics.surface(counts, [(i, j) for i in range(23) for j in range(23)]).collect()]  # 529 rows
    score = {(i, j): f for i, j, f in table}
    i, j = metrics.descend(table, max(range(23), key=lambda k: (score[k, k], -k)))
    rows = [("thr", GRID[k], GRID[k], score[k, k]) for k in range(23)] + [("src", GRID[i], GRID[j], score[i, j])]
    out = spark.createDataFrame(rows, "rule string, p1 double, p2 double, macro_f05 double")
    for alpha in (0.0, 0.1, 0.2):
        x = metrics.evaluate(decide.expected_f(best, alpha), truth, ids)
        out = out.unionByName(x.select(F.lit("expf").alias("rule"), F.lit(alpha).alias("p1"), F.lit(alpha).alias("p2"), "macro_f05"))
    return rounded(out, "macro_f05")


_T = "(40 + 5 * {0}) / 100::DOUBLE"


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, {_surface(12, 40, 5, 100, 'WHERE abs(g2.i - g3.i) <= 2', 'country')}
SELECT country, {_T.format('i')} AS t2, {_T.format('j')} AS t3, round(m, 6) AS macro_f05 FROM sf QUALIFY row_number() OVER (PARTITION BY country ORDER BY m DESC, i, j) = 1""")
def tune_by_country(spark, d):
    """The best thresholds by source of each country."""
    table = metrics.surface(metrics.threshold_counts(*_all(spark, d), WIDE), NEAR, ["country"])
    at = lambda c: (F.lit(40) + 5 * F.col(c)) / F.lit(100.0)
    return rounded(metrics.best_setting(table, ["country"]).select("country", at("i").alias("t2"), at("j").alias("t3"), "macro_f05"), "macro_f05")


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, {_surface(12, 40, 5, 100, 'WHERE abs(g2.i - g3.i) <= 2', 'flag')}
SELECT flag::BIGINT AS flag, {_T.format('i')} AS t2, {_T.format('j')} AS t3, round(m, 6) AS macro_f05 FROM sf QUALIFY row_number() OVER (PARTITION BY flag ORDER BY m DESC, i, j) = 1""")
def tune_groups(spark, d):
    """I16: the best thresholds by source of entities with and without a flag."""
    best, truth, ids = _all(spark, d)
    table = metrics.surface(metrics.threshold_counts(best, truth, ids.withColumn("flag", F.expr("bigint(q % 3 = 0)")), WIDE), NEAR, ["flag"])
    at = lambda c: (F.lit(40) + 5 * F.col(c)) / F.lit(100.0)
    return rounded(metrics.best_setting(table, ["flag"]).select("flag", at("i").alias("t2"), at("j").alias("t3"), "macro_f05"), "macro_f05")


_LOWS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, s AS (SELECT DISTINCT q FROM best WHERE prob >= 0.9), r AS (SELECT * FROM best ANTI JOIN s USING (q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) = 1),
g AS (SELECT r.q, prob, {Q.f05('(gt.p IS NOT NULL)::INT', '1', 'ntrue')} - (ntrue = 0)::INT AS d, {Q._HALF.replace('q *', 'r.q *')} AS half FROM (SELECT r.*, ntrue FROM r JOIN nt USING (q)) r LEFT JOIN gt ON gt.q = r.q AND gt.p = r.p),
h AS (SELECT count(*) AS n, count(*) FILTER ({Q._HALF} = 0) AS na, count(*) FILTER ({Q._HALF} = 1) AS nb FROM ids),
v AS (SELECT unnest({_LOWS}::DOUBLE[]) AS setting),
t AS (SELECT setting, count(g.q) AS added, round(coalesce(sum(d), 0) / any_value(n), 9) AS gain_all, round(coalesce(sum(d) FILTER (half = 0), 0) / any_value(na), 9) AS gain_a, round(coalesce(sum(d) FILTER (half = 1), 0) / any_value(nb), 9) AS gain_b FROM v CROSS JOIN h LEFT JOIN g ON prob >= setting GROUP BY setting),
a AS (SELECT * FROM t ORDER BY gain_a DESC, setting LIMIT 1), b AS (SELECT * FROM t ORDER BY gain_b DESC, setting LIMIT 1)
SELECT t.setting, t.added, round(t.gain_all, 6) AS gain_all, round(t.gain_a, 6) AS gain_a, round(t.gain_b, 6) AS gain_b, (a.gain_b > 0 AND b.gain_a > 0)::BIGINT AS accepted, a.setting AS best_a, b.setting AS best_b FROM t, a, b""")
def rescue_cross_checked(spark, d):
    """Gains of a rescue rule by threshold on two halves, and whether each half's best gains on the other."""
    best, truth, ids = _all(spark, d)
    gains = metrics.rescue_gains(best, decide.threshold(best, 0.9), truth, ids.select("q", sampling.fold(F.col("q")).alias("half")), _LOWS)
    return rounded(gains.crossJoin(F.broadcast(metrics.cross_checked(gains).drop("setting"))), "gain_all", "gain_a", "gain_b")


def _pool(spark, d) -> DataFrame:
    """Orders as pool records with short names and addresses."""
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("concat(lower(replace(o_orderpriority, '-', ' ')), ' ', o_custkey % 7)").alias("name_key"), F.expr("CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(lower(o_orderstatus), ' ', o_custkey % 20) END").alias("addr_norm"))


_POOL = "pool AS (SELECT o_orderkey AS id, lower(replace(o_orderpriority, '-', ' ')) || ' ' || (o_custkey % 7) AS name_key, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lower(o_orderstatus) || ' ' || (o_custkey % 20) END AS addr_norm FROM orders)"


def _alike(a, b):
    return F.coalesce(strsim.jaccard(text.tokens(a), text.tokens(b)), F.lit(0.0))


_J = Q._JAC.format(a=Q.toks("i.{0}"), b=Q.toks("j.{0}"))
_SIB = f"""have AS (SELECT q, pool.* FROM best JOIN pool ON id = p WHERE prob >= 0.8), cand AS (SELECT q, p, pool.* FROM best JOIN pool ON id = p WHERE prob < 0.8 AND prob >= {{low}}),
sib AS (SELECT i.q, i.p, max(coalesce({_J.replace('{0}', 'name_key')}, 0)) AS s, max(CASE WHEN i.addr_norm <> '' AND j.addr_norm <> '' THEN coalesce({_J.replace('{0}', 'addr_norm')}, 0) ELSE 0 END) AS a FROM cand i JOIN have j ON i.q = j.q GROUP BY i.q, i.p)"""


@query(f"WITH {V.BEST}, {_POOL}, {_SIB.replace('{low}', '0.1')} SELECT q, p, round(prob, 6) AS prob FROM best WHERE prob >= 0.8 OR (q, p) IN (SELECT (q, p) FROM sib WHERE s >= 0.7)")
def sibling_rescue(spark, d):
    """Rejected pairs whose name is like that of a record the entity has."""
    return rounded(decide.siblings(Q.best_of(spark, d).select("q", "p", "prob"), _pool(spark, d), _alike, 0.8, 0.02, 0.7, 0.1), "prob")


@query(f"WITH {V.BEST}, {_POOL}, {_SIB.replace('{low}', '0.05')} SELECT q, p, round(prob, 6) AS prob FROM best WHERE prob >= 0.8 OR (q, p) IN (SELECT (q, p) FROM sib WHERE s >= 0.6 AND a >= 0.9)")
def sibling_address_rescue(spark, d):
    """As sibling_rescue, with the address as well."""
    return rounded(decide.siblings(Q.best_of(spark, d).select("q", "p", "prob"), _pool(spark, d), _alike, 0.8, 0.02, 0.6, 0.05, 0.9), "prob")


def _filter(mode: str):
    @query(f"""WITH {Q._RP}, here AS (SELECT country, addr_norm, count(*) AS n FROM records WHERE side = 'a' AND addr_norm <> '' GROUP BY ALL)
SELECT q, p FROM rp JOIN records a ON a.id = q JOIN records b ON b.id = p LEFT JOIN here h ON h.country = {'a' if mode == 's1' else 'b'}.country AND h.addr_norm = {'a' if mode == 's1' else 'b'}.addr_norm
WHERE NOT (coalesce(h.n, 0) > 1 AND a.country IN ('en', 'de') AND coalesce({Q._JAC.format(a=Q.toks('a.name_key'), b=Q.toks('b.name_key'))}, 0) < 0.6)""")
    def run(spark, d):
        n = V.records(spark, d)
        return decide.post_filter(Q._record_pairs(spark, d), n.where("side = 'a'"), n.where("side = 'b'"), ["en", "de"], _alike(F.col("name_a"), F.col("name_b")), 0.6, mode).select("q", "p")

    run.__doc__ = f"I14 where the shared address is that of {'the entity' if mode == 's1' else 'the pool record'}."
    Q.QUERIES[f"post_filter_{mode}"], Q.ORACLE_SQL[f"post_filter_{mode}"] = Q.QUERIES.pop("run"), Q.ORACLE_SQL.pop("run")


_filter("s1")
_filter("pool")

_RULES = [(0.5, 3), (0.2, 8), (0.01, 8), (0.005, 10), (0.002, 10), (0.001, 12), (0.0, 12), (0.0, 20)]


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {Q._LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob2 DESC, p) AS rk FROM lab),
v(least, most) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::BIGINT)' for a, b in _RULES)})
SELECT least, most, round(sum(y) FILTER (prob2 >= least AND rk <= most) / (SELECT sum(y) FROM r)::DOUBLE, 6) AS covered, round(count(*) FILTER (prob2 >= least AND rk <= most) / (SELECT count(DISTINCT q) FROM r)::DOUBLE, 6) AS per_entity FROM v, r GROUP BY least, most""")
def coverage_table(spark, d):
    """What rules for scoring candidates keep of the true pairs, and how many pairs they leave."""
    return rounded(metrics.coverage(Q.labelled(spark, d), _RULES), "covered", "per_entity")


_NAMED = Q._RUNS + ", runs AS (SELECT 'r' || r AS run, q, p FROM rs)"


def _named(spark, d) -> dict[str, DataFrame]:
    return {f"r{k}": r for k, r in enumerate(Q._runs(spark, d))}


@query(f"""WITH {_NAMED}, {V.IDS}, o AS (SELECT run, q, p, EXISTS (SELECT 1 FROM runs x WHERE x.run = n.run AND x.q = a.q AND x.p = a.p) AS new, EXISTS (SELECT 1 FROM r0 WHERE r0.q = a.q AND r0.p = a.p) AS old
  FROM (VALUES ('r1'), ('r2'), ('r3')) n(run), (SELECT DISTINCT q, p FROM runs) a),
e AS (SELECT run, q, count(*) FILTER (new AND NOT old) AS a, count(*) FILTER (old AND NOT new) AS r FROM o GROUP BY run, q)
SELECT n.run, country, count(*) AS entities, count(*) FILTER (coalesce(a, 0) + coalesce(r, 0) > 0) AS differ, sum(coalesce(a, 0))::BIGINT AS added, sum(coalesce(r, 0))::BIGINT AS removed
FROM (VALUES ('r1'), ('r2'), ('r3')) n(run) CROSS JOIN ids LEFT JOIN e ON e.run = n.run AND e.q = ids.q GROUP BY n.run, country""")
def run_disagreement(spark, d):
    """By run and country, how many entities differ from the reference run."""
    return ensemble.disagreement(_named(spark, d), "r0", V.ids(spark, d))


@query(f"WITH {Q._RUNS}, {V.IDS}, v AS (SELECT q, p, count(*) AS n FROM rs GROUP BY q, p) SELECT country, count(*) AS pairs, count(*) FILTER (n < 4) AS contested FROM v JOIN ids USING (q) GROUP BY country")
def contested_pairs(spark, d):
    """Pairs that not all runs have, by country."""
    return ensemble.contested(Q._runs(spark, d), V.ids(spark, d))


@query(f"""WITH {Q._RUNS}, {V.IDS}, w AS (SELECT q, p, sum(w) AS w FROM (SELECT q, p, 1 AS w FROM r0 UNION ALL SELECT q, p, 2 FROM r1) GROUP BY q, p)
SELECT country, count(*) FILTER (w = 1) AS only_a, count(*) FILTER (w = 2) AS only_b, count(*) FILTER (w = 3) AS both FROM w JOIN ids USING (q) GROUP BY country""")
def pair_sets_by_country(spark, d):
    """I31."""
    r = Q._runs(spark, d)
    return ensemble.pair_sets_by(r[0], r[1], V.ids(spark, d))


_SCORES = ["prob", "prob2", "ce", "ce8"]
_LONG = "lg AS (SELECT q, country, y, 'prob' AS score, prob AS v, ce FROM lab UNION ALL SELECT q, country, y, 'prob2', prob2, ce FROM lab UNION ALL SELECT q, country, y, 'ce', ce, ce FROM lab WHERE ce IS NOT NULL UNION ALL SELECT q, country, y, 'ce8', ce8, ce FROM lab WHERE ce8 IS NOT NULL)"


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {Q._LAB}, {_LONG} SELECT country, score, count(*) AS n, round(avg(((v >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(y) FILTER (v >= 0.5), 6) AS precision, round(avg((v >= 0.5)::INT) FILTER (y = 1), 6) AS recall FROM lg GROUP BY country, score""")
def scores_at_half(spark, d):
    """Accuracy, precision and recall of each score at 0.5, by country."""
    return rounded(metrics.at_half(Q.labelled(spark, d), _SCORES, "y", ["country"]), "accuracy", "precision", "recall")


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {Q._LAB}, {_LONG}, b AS (SELECT 'all' AS band, * FROM lg UNION ALL SELECT 'unsure', * FROM lg WHERE ce > 0.05 AND ce < 0.95),
k AS (SELECT *, rank() OVER (PARTITION BY band, score ORDER BY v) + (count(*) OVER (PARTITION BY band, score, v) - 1) / 2.0 AS rk FROM b),
a AS (SELECT band, score, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE / (sum(y) * sum(1 - y)), 6) AS auc FROM k GROUP BY band, score),
h AS (SELECT band, score, v, sum(y) AS pos, count(*) AS n FROM b GROUP BY band, score, v), r AS (SELECT band, score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM h WINDOW w AS (PARTITION BY band, score ORDER BY v DESC ROWS UNBOUNDED PRECEDING))
SELECT a.band, a.score, any_value(auc) AS auc, round(sum(pos * tp / al::DOUBLE) / sum(pos), 6) AS ap FROM a JOIN r ON a.band = r.band AND a.score = r.score GROUP BY a.band, a.score""")
def band_scores(spark, d):
    """AUC and average precision of four scores, over all pairs and where the cross-encoder is unsure."""
    x = Q.labelled(spark, d)
    out = None
    for band, rows in (("all", x), ("unsure", x.where("ce > 0.05 AND ce < 0.95"))):
        for score in _SCORES:
            one = metrics.auc(rows, score, "y").select(F.lit(band).alias("band"), F.lit(score).alias("score"), "auc").crossJoin(F.broadcast(metrics.average_precision(rows, score, "y")))
            out = one if out is None else out.unionByName(one)
    return rounded(out, "auc", "ap")


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {Q._LAB}, s AS (SELECT q, p, y, prob AS s FROM lab), t AS (SELECT q, max(y) AS any_, arg_max(y, s * 10000000000 - p) AS top FROM s GROUP BY q)
SELECT count(*) AS rows, round(avg(-(y * ln(s + 0.000001::DOUBLE) + (1 - y) * ln(1 - s + 0.000001::DOUBLE))), 6) AS logloss, round(avg(s) FILTER (y = 1), 6) AS mean_pos, round(avg(s) FILTER (y = 0), 6) AS mean_neg, round(avg((s < 0.5)::INT) FILTER (y = 1), 6) AS pos_below, round(avg((s > 0.5)::INT) FILTER (y = 0), 6) AS neg_above, (SELECT round(avg(top), 6) FROM t WHERE any_ = 1) AS top1 FROM s""")
def hold_out(spark, d):
    """Log-loss, top-1 accuracy of groups, mean scores and error rates."""
    return rounded(metrics.hold_out(Q.labelled(spark, d).select("q", "p", "prob", "y"), "q", "prob", "y"), "logloss", "mean_pos", "mean_neg", "pos_below", "neg_above", "top1")


_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(f"""WITH {V.PAIRS}, {V.IDS}, {V.TRUTH}, {_NT}, w AS (SELECT unnest({_WEIGHTS}::DOUBLE[]) AS weight), s AS (SELECT weight, q, p, src, CASE WHEN ce8 IS NULL THEN prob ELSE (1 - weight) * prob + weight * ce8 END AS prob FROM pairs, w),
o AS (SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY weight, p ORDER BY prob DESC, q) = 1) WHERE prob >= CASE WHEN src = 2 THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END),
n AS (SELECT weight, o.q, count(gt.p) AS tp, count(*) AS np FROM o LEFT JOIN gt ON gt.q = o.q AND gt.p = o.p GROUP BY weight, o.q), touched AS (SELECT DISTINCT q FROM pairs WHERE ce8 IS NOT NULL)
SELECT w.weight, round(avg({Q.f05('coalesce(tp, 0)', 'coalesce(np, 0)', 'ntrue')}), 6) AS macro_f05, round(avg({Q.f05('coalesce(tp, 0)', 'coalesce(np, 0)', 'ntrue')}) FILTER (nt.q IN (SELECT q FROM touched)), 6) AS touched_f05 FROM w CROSS JOIN nt LEFT JOIN n ON n.weight = w.weight AND n.q = nt.q GROUP BY w.weight""")
def blend_sweep(spark, d):
    """A blend's weights, over all entities and those it touches."""
    x = V.pairs(spark, d)
    ext = x.where("ce8 IS NOT NULL").select("q", "p", F.col("ce8").alias("p_ext"))
    return rounded(ensemble.blend_sweep(x.select("q", "p", "src", "prob"), ext, _WEIGHTS, 0.75, 0.7, V.truth(x), V.ids(spark, d)), "macro_f05", "touched_f05")


_BINS, _BINS2 = [0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.76], [-0.01, 0.25, 0.5, 0.75, 1.0]


def _bin(c: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} > {a}::DOUBLE AND {c} <= {b}::DOUBLE THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:]))) + " END::BIGINT"


_RC = "rc AS (SELECT b.*, (gt.p IS NOT NULL)::INT AS y FROM best b LEFT JOIN gt ON gt.q = b.q AND gt.p = b.p WHERE prob >= 0.02 AND prob < 0.76)"


def _rescue_candidates(spark, d) -> DataFrame:
    best, truth, _ = _all(spark, d)
    return sampling.label(best.where("prob >= 0.02 AND prob < 0.76"), truth)


@query(f"WITH {V.BEST}, {V.TRUTH}, {_RC}, t AS (SELECT 'country' AS trait, country AS value, y, prob FROM rc UNION ALL SELECT 'src', src::VARCHAR, y, prob FROM rc UNION ALL SELECT 'prob', ({_bin('prob', _BINS)})::VARCHAR, y, prob FROM rc) SELECT trait, value, count(*) AS n, round(avg(y), 6) AS rate FROM t WHERE value IS NOT NULL GROUP BY trait, value")
def rescue_hit_rates(spark, d):
    """How often rejected candidates are true, by score bucket, country and source."""
    x = _rescue_candidates(spark, d).withColumn("bucket", metrics.right_closed(F.col("prob"), _BINS))
    traits = F.array(*[F.struct(F.lit(n).alias("trait"), F.col(c).cast("string").alias("value")) for n, c in (("country", "country"), ("src", "src"), ("prob", "bucket"))])
    long = x.select("y", F.explode(traits).alias("t")).select("y", "t.*").where("value IS NOT NULL")
    return rounded(long.groupBy("trait", "value").agg(F.count("*").alias("n"), F.avg("y").alias("rate")), "rate")


@query(f"WITH {V.BEST}, {V.TRUTH}, {_RC}, b AS (SELECT {_bin('prob', _BINS)} AS bin, {_bin('comb', _BINS2)} AS bin2, y FROM rc) SELECT bin, bin2, count(*) AS n, round(avg(y), 6) AS rate FROM b WHERE bin IS NOT NULL AND bin2 IS NOT NULL GROUP BY bin, bin2")
def binned_rate_2d(spark, d):
    """Size and hit rate by the bins of two columns."""
    return rounded(metrics.binned_rate2(_rescue_candidates(spark, d), "prob", _BINS, "comb", _BINS2, "y"), "rate")


@query(f"WITH {V.PAIRS} SELECT DISTINCT q, dense_rank() OVER (ORDER BY q)::BIGINT - 1 AS gid FROM pairs")
def dense_group_ids(spark, d):
    """G11 over all entities, without a global sort."""
    return metrics.dense_ids(V.pairs(spark, d).select("q").distinct(), "q")


@query(f"WITH {V.PAIRS} SELECT q, p, round(prob, 6) AS prob FROM pairs ORDER BY prob DESC, q, p LIMIT 50")
def surest_pairs(spark, d):
    """The first rows of an order; each task keeps no more than the limit."""
    return rounded(V.pairs(spark, d).orderBy(F.desc("prob"), "q", "p").limit(50).select("q", "p", "prob"), "prob")


@query(f"WITH {V.PAIRS} SELECT q, p, round(comb, 6) AS comb FROM pairs WHERE (country IN ('c1', 'c2') AND comb >= 0.3) OR (country NOT IN ('c1', 'c2') AND comb >= 0.5)")
def redo_countries(spark, d):
    """Candidates of two countries made anew, all others as they were."""
    x = V.pairs(spark, d)
    return rounded(blocking.replace_countries(x.where("comb >= 0.5"), x.where("comb >= 0.3"), ["c1", "c2"]).select("q", "p", "comb"), "comb")


@query(f"""WITH {V.PAIRS}, {V.IDS}, {V.TRUTH}, own AS (SELECT q, count(*) FILTER (p % 2 = 0) AS n2, count(*) FILTER (p % 2 <> 0) AS n3 FROM gt GROUP BY q),
cb AS (SELECT coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, count(*) AS n FROM ids LEFT JOIN own USING (q) GROUP BY 1, 2), cu AS (SELECT n2, n3, (sum(n) OVER w - n) / sum(n) OVER ()::DOUBLE AS low, sum(n) OVER w / sum(n) OVER ()::DOUBLE AS high FROM cb WINDOW w AS (ORDER BY n2, n3 ROWS UNBOUNDED PRECEDING))
SELECT q, n2, n3 FROM (SELECT q, {Q._MIX1.format(seed=21, a='q')} / 999983::DOUBLE AS u FROM ids) JOIN cu ON u >= low AND u < high""")
def world_counts(spark, d):
    """How many copies of each entity a synthetic world has, drawn from the counts of the truth."""
    _, truth, ids = _all(spark, d)
    own = truth.groupBy("q").agg(F.count_if(F.expr("p % 2 = 0")).alias("n2"), F.count_if(F.expr("p % 2 <> 0")).alias("n3"))
    return synth.copy_counts(ids.select("q"), ids.select("q").join(own, "q", "left").na.fill(0), 21)


@query(f"""WITH {V.PAIRS}, {V.IDS}, m AS (SELECT p, min(src) AS src, max(prob) AS prob FROM pairs GROUP BY p), f AS (SELECT * FROM m WHERE prob < 0.3)
SELECT p, src FROM f WHERE {Q._MIX1.format(seed=22, a='p')} / 999983::DOUBLE < least(1, 0.5::DOUBLE * (SELECT count(*) FROM ids) / (SELECT count(*) FROM f))""")
def world_decoys(spark, d):
    """Pool records that no entity is likely to own, sampled to a share of the entities, of both sources."""
    x = V.pairs(spark, d)
    pool = x.groupBy("p").agg(F.min("src").alias("src"))
    return synth.unowned(pool, x, V.ids(spark, d), 0.3, 0.5, 22).select("p", "src")


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, kept AS (SELECT * FROM nt WHERE {Q._MIX1.format(seed=23, a='q')} / 999983::DOUBLE >= 0.1), g AS (SELECT (40 + 10 * i) / 100::DOUBLE AS t FROM range(6) r(i)),
n AS (SELECT t, b.q, count(gt.p) AS tp, count(*) AS np FROM best b JOIN g ON prob >= t LEFT JOIN gt ON gt.q = b.q AND gt.p = b.p GROUP BY t, b.q)
SELECT g.t, round(avg({Q.f05('coalesce(tp, 0)', 'coalesce(np, 0)', 'ntrue')}), 6) AS macro_f05, round(avg((coalesce(np, 0) > 0)::INT), 6) AS covered FROM g CROSS JOIN kept LEFT JOIN n ON n.t = g.t AND n.q = kept.q GROUP BY g.t""")
def world_evaluation(spark, d):
    """I32: thresholds on a world from which a share of the entities was dropped: macro F0.5 and the share with a match."""
    best, truth, ids = _all(spark, d)
    kept = ids.where(sampling.uniform(F.col("q"), seed=23) >= 0.1)
    grid = [(40 + 10 * k) / 100 for k in range(6)]
    counts = metrics.threshold_counts(best, truth, kept, grid)
    table = metrics.surface(counts, [(k, k) for k in range(6)])
    cover = counts.select(F.posexplode(F.zip_with("n2", "n3", lambda a, b: ((a + b) > 0).cast("double"))).alias("i", "c")).groupBy("i").agg(F.avg("c").alias("covered"))
    at = (F.lit(40) + 10 * F.col("i")) / F.lit(100.0)
    return rounded(table.join(F.broadcast(cover), "i").select(at.alias("t"), "macro_f05", "covered"), "macro_f05", "covered")
