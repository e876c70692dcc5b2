"""The engine's queries over the shared tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strsim, text
from ..operators import blocking, competition, decide, ensemble, metrics, models, sampling, synth, translit
from ..operators import records as rec
from ..sources import lists
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def best_of(spark: SparkSession, d: str) -> DataFrame:
    return decide.assign_best(V.pairs(spark, d))


# ------------------------------------------------------------------ lists, scans and projections


@query(f"""WITH {V.BEST}, {V.IDS},
g AS (SELECT q, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS l FROM best WHERE prob >= 0.6 GROUP BY q)
SELECT ids.q::VARCHAR AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM ids LEFT JOIN g USING (q)""")
def match_lists(spark, d):
    """Sorted comma lists, one row an entity."""
    return lists.to_lists(decide.threshold(best_of(spark, d), 0.6), V.ids(spark, d))


@query(f"WITH {V.BEST} SELECT q::VARCHAR AS q, p::VARCHAR AS p FROM best WHERE prob >= 0.6")
def list_explode(spark, d):
    """Lists back to pairs, empty ids dropped."""
    return lists.explode_lists(match_lists(spark, d))


@query("SELECT s_suppkey AS id, trim(s_name) || ' | ' || trim(n_name) AS a, r_name || ': ' || trim(s_name) || ' | ' || trim(n_name) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def text_pairs(spark, d):
    """Text pairs, with and without the country."""
    t = lambda n: V.table(spark, d, n)
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s_suppkey").alias("id"), lists.text_pair(F.col("s_name"), F.col("n_name")).alias("a"), lists.text_pair(F.col("s_name"), F.col("n_name"), F.col("r_name")).alias("b"))


@query(f"""WITH {V.PAIRS} SELECT q, p, CASE WHEN prob > 0.5 OR ce IS NULL THEN 1 ELSE 0 END::BIGINT AS flag, round(ln(1 + abs(coalesce(ce, 0) - prob)), 6) AS dev,
round(sqrt(greatest(0, least(0.5, prob))), 6) AS clipped, starts_with(country, 'c1') AS here FROM pairs WHERE NOT (src = 2 AND prob < 0.3)""")
def projections(spark, d):
    """Filters, conditions, arithmetic, null tests, string predicates."""
    x = V.pairs(spark, d).where(~((F.col("src") == 2) & (F.col("prob") < 0.3)))
    return x.select("q", "p", F.when((F.col("prob") > 0.5) | F.col("ce").isNull(), 1).otherwise(0).cast("long").alias("flag"), F.round(F.log1p(F.abs(F.coalesce("ce", F.lit(0.0)) - F.col("prob"))), 6).alias("dev"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.col("prob")))), 6).alias("clipped"), F.col("country").startswith("c1").alias("here"))


# ------------------------------------------------------------------ competition features

_CTX = ", ".join(f"rank() OVER (PARTITION BY {s} ORDER BY {c} DESC)::BIGINT AS {s}_rank_{c}, round(max({c}) OVER (PARTITION BY {s}) - {c}, 6) AS {s}_gap_{c}" for s in "qp" for c in ("name_cos", "addr_cos", "comb"))


@query(f"""WITH {V.PAIRS} SELECT q, p, count(*) OVER (PARTITION BY q) AS q_n, count(*) OVER (PARTITION BY p) AS p_n, {_CTX},
round(coalesce(nth_value(comb, 2) OVER (PARTITION BY p ORDER BY comb DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) AS p_second_comb FROM pairs""")
def context_features(spark, d):
    """D1-D5."""
    x = competition.context_features(V.pairs(spark, d).select("q", "p", "name_cos", "addr_cos", "comb"))
    return rounded(x, *[f"{s}_gap_{c}" for s in "qp" for c in ("name_cos", "addr_cos", "comb")], "p_second_comb").drop("name_cos", "addr_cos", "comb")


def _second(c, part):
    return f"round(coalesce(nth_value({c}, 2) OVER (PARTITION BY {part} ORDER BY {c} DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6)"


@query(f"""WITH {V.PAIRS} SELECT q, p, src, round(prob, 6) AS prob, rank() OVER (PARTITION BY q ORDER BY prob DESC)::BIGINT AS q_rank, round(max(prob) OVER (PARTITION BY q) - prob, 6) AS q_gap,
round(sum(prob) OVER (PARTITION BY q), 6) AS q_sum, (count(*) FILTER (prob > 0.5) OVER (PARTITION BY q))::BIGINT AS q_strong, {_second('prob', 'q')} AS q_second,
rank() OVER (PARTITION BY q, src ORDER BY prob DESC)::BIGINT AS q_src_rank, rank() OVER (PARTITION BY p ORDER BY prob DESC)::BIGINT AS p_rank,
round(max(prob) OVER (PARTITION BY p) - prob, 6) AS p_gap, (count(*) FILTER (prob > 0.5) OVER (PARTITION BY p))::BIGINT AS p_strong, {_second('prob', 'p')} AS p_second FROM pairs""")
def prob_features(spark, d):
    """D6, D7."""
    return rounded(competition.prob_features(V.pairs(spark, d).select("q", "p", "src", "prob")), "prob", "q_gap", "q_sum", "q_second", "p_gap", "p_second")


@query(f"""WITH {V.PAIRS}, s AS (SELECT q, p, rank() OVER (PARTITION BY q ORDER BY ce DESC)::BIGINT AS ce_q_rank, max(ce) OVER (PARTITION BY q) - ce AS ce_q_gap,
rank() OVER (PARTITION BY p ORDER BY ce DESC)::BIGINT AS ce_p_rank, max(ce) OVER (PARTITION BY p) - ce AS ce_p_gap FROM pairs WHERE ce IS NOT NULL)
SELECT q, p, ce_q_rank, round(ce_q_gap, 6) AS ce_q_gap, ce_p_rank, round(ce_p_gap, 6) AS ce_p_gap, (ce IS NOT NULL)::BIGINT AS ce_scored, round(ce - prob2, 6) AS ce_diff FROM pairs LEFT JOIN s USING (q, p)""")
def scored_features(spark, d):
    """D8."""
    x = competition.scored_features(V.pairs(spark, d).select("q", "p", "ce", "prob2"))
    return rounded(x, "ce_q_gap", "ce_p_gap", "ce_diff").drop("ce", "prob2")


_STK = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {s} ORDER BY {c} DESC NULLS LAST) END::BIGINT AS {c}_{s}_rank, round(max({c}) OVER (PARTITION BY {s}) - {c}, 6) AS {c}_{s}_gap" for s in "qp" for c in ("prob", "ce", "ce8"))
_STQ = ", ".join(f"round(sum({c}) OVER (PARTITION BY q), 6) AS {c}_q_sum, {_second(c, 'q')} AS {c}_q_second" for c in ("prob", "ce", "ce8"))


@query(f"WITH {V.PAIRS} SELECT q, p, {_STK}, {_STQ} FROM pairs")
def stack_context(spark, d):
    """D9."""
    cs = ("prob", "ce", "ce8")
    x = competition.stack_context(V.pairs(spark, d).select("q", "p", *cs))
    return rounded(x, *[f"{c}_{s}_gap" for s in "qp" for c in cs], *[f"{c}_q_{k}" for c in cs for k in ("sum", "second")]).drop(*cs)


@query(f"""WITH {V.PAIRS} SELECT q, p, count(*) OVER (PARTITION BY q) AS n_q, count(*) OVER (PARTITION BY p) AS n_p, count(*) OVER (PARTITION BY q, src) AS n_qs,
round(ce8 - ce, 6) AS ce8_ce, round(ce8 - prob, 6) AS ce8_prob, round(ce - prob, 6) AS ce_prob FROM pairs""")
def group_sizes(spark, d):
    """D10."""
    x = competition.group_sizes(V.pairs(spark, d).select("q", "p", "src", "prob", "ce", "ce8"))
    return rounded(x, "ce8_ce", "ce8_prob", "ce_prob").drop("src", "prob", "ce", "ce8")


@query(f"WITH {V.PAIRS} SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY prob2 DESC, p)::BIGINT AS rk, row_number() OVER (PARTITION BY q, src ORDER BY prob DESC, p)::BIGINT AS rk_src FROM pairs")
def positions(spark, d):
    """D11, D12."""
    x = competition.position(V.pairs(spark, d), ["q"], "prob2", "rk")
    return competition.position(x, ["q", "src"], "prob", "rk_src").select("q", "p", "rk", "rk_src")


@query(f"WITH {V.PAIRS} SELECT q, p, round(prob2, 6) AS prob2 FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob2 DESC, p) <= 6")
def top_six(spark, d):
    """D13."""
    return rounded(competition.top_k(V.pairs(spark, d).select("q", "p", "prob2"), ["q"], "prob2", 6), "prob2")


_MIX = "((((({seed} * 48271 + ({a} % 999983) * 69621 + 12345) % 999983) * 48271 + ({b} % 999983) * 69621 + 12345) % 999983) * 48271 + 11) % 999983"
_MIX1 = "((({seed} * 48271 + ({a} % 999983) * 69621 + 12345) % 999983) * 48271 + 11) % 999983"


@query(f"WITH {V.PAIRS} SELECT q, p FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY {_MIX.format(seed=5, a='q', b='p')}, q, p) <= 3")
def random_three(spark, d):
    """D14."""
    return competition.random_k(V.pairs(spark, d).select("q", "p"), ["q"], 3, 5)


@query(f"""WITH {V.RECORDS} SELECT id, (count(*) OVER (PARTITION BY country, name_key) > 1)::BIGINT AS name_key_shared, (count(*) OVER (PARTITION BY country, addr_norm) > 1)::BIGINT AS addr_norm_shared FROM records""")
def shared_keys(spark, d):
    """D15."""
    return competition.shared_keys(V.records(spark, d), ["name_key", "addr_norm"]).select("id", "name_key_shared", "addr_norm_shared")


# ------------------------------------------------------------------ decisions


@query(f"WITH {V.BEST} SELECT q, p, src, round(prob, 6) AS prob FROM best")
def assign_best(spark, d):
    """I1, G9, G10."""
    return rounded(best_of(spark, d).select("q", "p", "src", "prob"), "prob")


@query(f"WITH {V.BEST} SELECT q, p, round(prob, 6) AS prob FROM best WHERE prob >= 0.7")
def threshold(spark, d):
    """I2, I3."""
    return rounded(decide.decide(best_of(spark, d), ("thr", 0.7)).select("q", "p", "prob"), "prob")


@query(f"WITH {V.BEST} SELECT q, p, round(prob, 6) AS prob FROM best WHERE prob >= CASE WHEN src = 2 THEN 0.7 ELSE 0.55 END")
def threshold_by_source(spark, d):
    """I4."""
    return rounded(decide.decide(best_of(spark, d), ("src", 0.7, 0.55)).select("q", "p", "prob"), "prob")


def _expected(alpha):
    return f"""ed AS (SELECT *, row_number() OVER w AS j, sum(prob) OVER w AS tp, sum(prob) OVER (PARTITION BY q) + {alpha}::DOUBLE AS t,
exp(sum(ln(1 - least(prob, 0.999999::DOUBLE))) OVER (PARTITION BY q) - {alpha}::DOUBLE) AS f0 FROM best WHERE prob >= 0.05::DOUBLE WINDOW w AS (PARTITION BY q ORDER BY prob DESC, p ROWS UNBOUNDED PRECEDING)),
ee AS (SELECT *, round(1.25::DOUBLE * tp / (1.25::DOUBLE * tp + 0.25::DOUBLE * (t - tp) + (j - tp)), 9) AS f FROM ed),
eg AS (SELECT *, max(f) OVER (PARTITION BY q) AS bf FROM ee),
eh AS (SELECT *, min(CASE WHEN f = bf THEN j END) OVER (PARTITION BY q) AS bj FROM eg),
chosen AS (SELECT q, p, src, prob, country FROM eh WHERE bf > round(f0, 9) AND j <= bj)"""


@query(f"WITH {V.BEST}, {_expected(0)} SELECT q, p, round(prob, 6) AS prob FROM chosen")
def expected_f(spark, d):
    """I5, I6, G12, G13."""
    return rounded(decide.decide(best_of(spark, d), ("expf", 0.0)).select("q", "p", "prob"), "prob")


@query(f"WITH {V.BEST}, {_expected(0.3)} SELECT q, p, round(prob, 6) AS prob FROM chosen")
def expected_f_alpha(spark, d):
    """I5 with missed mass, I30."""
    return rounded(decide.decide(best_of(spark, d), ("expf", 0.3)).select("q", "p", "prob"), "prob")


@query(f"""WITH {V.BEST}, {_expected(0)}, {V.IDS}, g AS (SELECT q, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS l FROM chosen GROUP BY q)
SELECT ids.q::VARCHAR AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM ids LEFT JOIN g USING (q)""")
def flagship(spark, d):
    """Which records does each entity own, and which are worth emitting?"""
    return lists.to_lists(decide.expected_f(best_of(spark, d)), V.ids(spark, d))


@query(f"""WITH {V.PAIRS}, rules(country, scale, cut) AS (VALUES ('c1', 0.8::DOUBLE, 0.5::DOUBLE), ('c2', 1.2::DOUBLE, 0.9::DOUBLE)),
s AS (SELECT q, p, greatest(0, least(1, prob * coalesce(scale, 1))) AS prob, cut FROM pairs LEFT JOIN rules USING (country)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p ORDER BY prob DESC, q) = 1)
SELECT q, p, round(prob, 6) AS prob FROM b WHERE prob >= coalesce(cut, 0.7::DOUBLE)""")
def country_rules(spark, d):
    """I7."""
    rules = spark.createDataFrame([("c1", 0.8, 0.5), ("c2", 1.2, 0.9)], "country string, scale double, cut double")
    return rounded(decide.country_rules(V.pairs(spark, d), rules, 0.7).select("q", "p", "prob"), "prob")


def f05(tp, n, t):
    return f"(CASE WHEN {n} = 0 AND {t} = 0 THEN 1::DOUBLE WHEN {n} = 0 OR {t} = 0 OR {tp} = 0 THEN 0::DOUBLE ELSE 1.25::DOUBLE * ({tp}::DOUBLE / {n}) * ({tp}::DOUBLE / {t}) / (0.25::DOUBLE * ({tp}::DOUBLE / {n}) + ({tp}::DOUBLE / {t})) END)"


_NT = "nt AS (SELECT ids.q, coalesce(c, 0) AS ntrue FROM ids LEFT JOIN (SELECT q, count(DISTINCT p) AS c FROM gt GROUP BY q) USING (q))"


def _tuned(grid, cond, by):
    return f"""{_NT}, {grid},
per AS (SELECT {by}, b.q, count(gt.p) AS tp, count(*) AS n FROM grid JOIN best b ON {cond} LEFT JOIN gt ON gt.q = b.q AND gt.p = b.p GROUP BY {by}, b.q),
every AS (SELECT * FROM grid CROSS JOIN nt)
SELECT {by}, round(avg({f05('coalesce(tp, 0)', 'coalesce(n, 0)', 'ntrue')}), 6) AS macro_f05 FROM every LEFT JOIN per USING ({by}, q) GROUP BY {by}"""


@query(f"WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_tuned('grid AS (SELECT (200 + 25 * i)::BIGINT AS t FROM range(31) r(i))', 'b.prob >= t / 1000::DOUBLE', 't')}")
def tune_threshold(spark, d):
    """I8: the whole grid in one pass."""
    all_ = V.pairs(spark, d)
    counts = metrics.threshold_counts(decide.assign_best(all_), V.truth(all_), V.ids(spark, d), [(200 + 25 * k) / 1000 for k in range(31)])
    table = metrics.surface(counts, [(k, k) for k in range(31)])
    return rounded(table.select((F.col("i").cast("long") * 25 + 200).alias("t"), "macro_f05"), "macro_f05")


@query(f"WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_tuned('grid AS (SELECT 50 + 5 * a.i AS t2, 50 + 5 * b.i AS t3 FROM range(9) a(i), range(9) b(i) WHERE abs(a.i - b.i) <= 2)', 'b.prob >= CASE WHEN src = 2 THEN t2 ELSE t3 END / 100::DOUBLE', 't2, t3')}")
def tune_by_source(spark, d):
    """I10."""
    all_ = V.pairs(spark, d)
    counts = metrics.threshold_counts(decide.assign_best(all_), V.truth(all_), V.ids(spark, d), [(50 + 5 * k) / 100 for k in range(9)])
    table = metrics.surface(counts, [(i, j) for i in range(9) for j in range(9) if abs(i - j) <= 2])
    at = lambda c: F.col(c).cast("long") * 5 + 50
    return rounded(table.select(at("i").alias("t2"), at("j").alias("t3"), "macro_f05"), "macro_f05")


@query(f"""WITH {V.BEST}, s AS (SELECT q, p, prob FROM best WHERE prob >= 0.9), r AS (SELECT q, p, prob FROM best ANTI JOIN s USING (q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) = 1)
SELECT q, p, round(prob, 6) AS prob FROM (SELECT * FROM s UNION ALL SELECT * FROM r WHERE prob >= 0.4)""")
def rescue_empty(spark, d):
    """I11."""
    best = best_of(spark, d).select("q", "p", "prob")
    return rounded(decide.rescue_empty(best, decide.threshold(best, 0.9), 0.4), "prob")


_HALF = "(((q * 2654435761) >> 7) % 2)"


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, s AS (SELECT q, p FROM best WHERE prob >= 0.9),
r AS (SELECT q, p FROM best ANTI JOIN s USING (q) WHERE prob >= 0.4 QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) = 1),
x AS (SELECT 'base' AS rule, * FROM s UNION ALL SELECT 'rescue', * FROM s UNION ALL SELECT 'rescue', * FROM r),
n AS (SELECT rule, x.q, count(gt.p) AS tp, count(*) AS np FROM x LEFT JOIN gt ON gt.q = x.q AND gt.p = x.p GROUP BY ALL)
SELECT rule, {_HALF}::BIGINT AS half, round(avg({f05('coalesce(tp, 0)', 'coalesce(np, 0)', 'ntrue')}), 6) AS macro_f05 FROM (VALUES ('base'), ('rescue')) v(rule) CROSS JOIN nt LEFT JOIN n USING (rule, q) GROUP BY ALL""")
def rescue_by_half(spark, d):
    """A rule's score on two halves of the entities."""
    all_ = V.pairs(spark, d)
    best, truth = decide.assign_best(all_).select("q", "p", "prob"), V.truth(all_)
    base = decide.threshold(best, 0.9)
    ids = V.ids(spark, d).withColumn("half", sampling.fold(F.col("q")))
    parts = []
    for rule, chosen in (("base", base), ("rescue", decide.rescue_empty(best, base, 0.4))):
        n = metrics.entity_counts(chosen, truth, ids).join(ids, "q")
        parts.append(n.groupBy(F.lit(rule).alias("rule"), "half").agg(F.round(F.avg(metrics.f05(F.col("tp"), F.col("npred"), F.col("ntrue"))), 6).alias("macro_f05")))
    return parts[0].unionByName(parts[1])


def _record_pairs(spark, d) -> DataFrame:
    """Pairs of documents for the record rules: each query record with three pool records by arithmetic."""
    n = V.records(spark, d)
    a, b = n.where("side = 'a'"), n.where("side = 'b'").select(F.col("id").alias("p"))
    return a.select(F.col("id").alias("q"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2, F.col("id") + 31)).alias("p")).join(b, "p", "left_semi").select("q", "p", F.expr("((q * 7 + p) % 101) / 101D").alias("prob"))


_RP = V.RECORDS + """, rp AS (SELECT q, p, ((q * 7 + p) % 101) / 101::DOUBLE AS prob FROM (SELECT id AS q, unnest([id + 1, id + 2, id + 31]) AS p FROM records WHERE side = 'a') WHERE p IN (SELECT id FROM records WHERE side = 'b'))"""


@query(f"""WITH {_RP}, a AS (SELECT id AS q, count(*) OVER (PARTITION BY country, name_key) > 1 AS shared FROM records WHERE side = 'a')
SELECT q, p FROM rp JOIN a USING (q) JOIN records r ON r.id = p WHERE NOT (shared AND r.addr_norm = '')""")
def drop_ambiguous(spark, d):
    """I13."""
    n = V.records(spark, d)
    pool = n.where("side = 'b'").withColumn("addr_empty", (F.col("addr_norm") == "").cast("int"))
    return decide.drop_ambiguous(_record_pairs(spark, d), n.where("side = 'a'"), pool).select("q", "p")


_JAC = "(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def toks(c):
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"


@query(f"""WITH {_RP}, here AS (SELECT country, addr_norm, count(*) AS n FROM records WHERE side = 'a' AND addr_norm <> '' GROUP BY ALL)
SELECT q, p FROM rp JOIN records a ON a.id = q JOIN records b ON b.id = p LEFT JOIN here ha ON ha.country = a.country AND ha.addr_norm = a.addr_norm LEFT JOIN here hb ON hb.country = b.country AND hb.addr_norm = b.addr_norm
WHERE NOT ((coalesce(ha.n, 0) > 1 OR coalesce(hb.n, 0) > 1) AND a.country IN ('en', 'de') AND (coalesce({_JAC.format(a=toks('a.name_key'), b=toks('b.name_key'))}, 0) < 0.6 OR prob < 0.9))""")
def post_filter(spark, d):
    """I14, with Jaccard as the name similarity."""
    n = V.records(spark, d)
    alike = F.coalesce(strsim.jaccard(text.tokens(F.col("name_a")), text.tokens(F.col("name_b"))), F.lit(0.0))
    return decide.post_filter(_record_pairs(spark, d), n.where("side = 'a'"), n.where("side = 'b'"), ["en", "de"], alike, 0.6, "either", 0.9).select("q", "p")


@query(f"""WITH {V.BEST}, ch AS (SELECT q, p, src, prob FROM best WHERE prob >= 0.7), have AS (SELECT q, max((src = 2)::INT) AS h2, max((src = 3)::INT) AS h3 FROM ch GROUP BY q),
c AS (SELECT q, p, src, prob FROM best WHERE prob < 0.7 AND prob >= 0.02 QUALIFY row_number() OVER (PARTITION BY q, src ORDER BY prob DESC, p) = 1)
SELECT q, p, src, round(prob, 6) AS prob FROM (SELECT * FROM ch UNION ALL SELECT c.* FROM c JOIN have USING (q) WHERE prob >= 0.3 AND CASE WHEN src = 2 THEN h3 = 1 AND h2 = 0 ELSE h2 = 1 AND h3 = 0 END)""")
def source_completion(spark, d):
    """I15."""
    return rounded(decide.completion(best_of(spark, d).select("q", "p", "src", "prob"), 0.7, 0.02, 0.3), "prob")


@query(f"WITH {V.BEST} SELECT q, p FROM best WHERE prob >= CASE WHEN q % 3 = 0 THEN 0.8 ELSE 0.5 END")
def group_threshold(spark, d):
    """I16."""
    return decide.group_threshold(best_of(spark, d).withColumn("f", F.expr("int(q % 3 = 0)")), "f", 0.8, 0.5).select("q", "p")


# ------------------------------------------------------------------ metrics

_EV = f"""{_NT}, n AS (SELECT s.q, count(gt.p) AS tp, count(*) AS np FROM chosen s LEFT JOIN gt ON gt.q = s.q AND gt.p = s.p GROUP BY s.q),
ev AS (SELECT nt.q, coalesce(tp, 0) AS tp, coalesce(np, 0) AS npred, ntrue FROM nt LEFT JOIN n USING (q))"""


@query(f"""WITH {V.BEST}, {_expected(0)}, {V.IDS}, {V.TRUTH}, {_EV}
SELECT round(avg({f05('tp', 'npred', 'ntrue')}), 6) AS macro_f05, round(avg(CASE WHEN npred > 0 THEN tp / npred::DOUBLE END), 6) AS mean_precision, round(avg(CASE WHEN ntrue > 0 THEN tp / ntrue::DOUBLE END), 6) AS mean_recall,
round(sum(tp) / greatest(1, sum(npred))::DOUBLE, 6) AS micro_precision, round(sum(tp) / greatest(1, sum(ntrue))::DOUBLE, 6) AS micro_recall, sum(tp)::BIGINT AS tp, count(*) AS n FROM ev""")
def evaluate(spark, d):
    """I17-I20, H26."""
    all_ = V.pairs(spark, d)
    x = metrics.evaluate(decide.expected_f(decide.assign_best(all_)), V.truth(all_), V.ids(spark, d))
    return rounded(x, "macro_f05", "mean_precision", "mean_recall", "micro_precision", "micro_recall")


@query(f"""WITH {V.BEST}, {V.TRUTH}, f AS (SELECT CASE WHEN c.q IS NULL THEN 'not a candidate' WHEN b.q IS NULL THEN 'lost to another' WHEN b.prob < 0.6 THEN 'below threshold' ELSE 'found' END AS fate
FROM gt LEFT JOIN pairs c ON c.q = gt.q AND c.p = gt.p LEFT JOIN best b ON b.q = gt.q AND b.p = gt.p)
SELECT fate, count(*) AS pairs, round(count(*) / (SELECT count(*) FROM gt)::DOUBLE, 6) AS share FROM f GROUP BY fate""")
def loss_table(spark, d):
    """I21."""
    all_ = V.pairs(spark, d)
    return rounded(metrics.loss_table(all_, decide.assign_best(all_), V.truth(all_), 0.6), "share")


@query(f"""WITH {V.BEST}, {V.IDS}, {V.TRUTH}, {_NT}, r AS (SELECT b.q, sum((gt.p IS NOT NULL)::INT) OVER w AS tp, row_number() OVER w AS j, ntrue FROM best b JOIN nt USING (q) LEFT JOIN gt ON gt.q = b.q AND gt.p = b.p WINDOW w AS (PARTITION BY b.q ORDER BY prob DESC, b.p ROWS UNBOUNDED PRECEDING)),
t AS (SELECT q, max({f05('tp', 'j', 'ntrue')}) AS prefix, max(tp) AS found FROM r GROUP BY q),
e AS (SELECT nt.q, ntrue, coalesce(prefix, 0) AS prefix, coalesce(found, 0) AS found FROM nt LEFT JOIN t USING (q))
SELECT round(avg({f05('found', 'found', 'ntrue')}), 6) AS oracle_f05, round(avg(greatest(prefix, CASE WHEN ntrue = 0 THEN 1 ELSE 0 END)), 6) AS prefix_f05, sum((ntrue > 0 AND found = 0)::INT)::BIGINT AS blocked_out FROM e""")
def ceilings(spark, d):
    """I22."""
    all_ = V.pairs(spark, d)
    return rounded(metrics.ceilings(decide.assign_best(all_), V.truth(all_), V.ids(spark, d)), "oracle_f05", "prefix_f05")


@query(f"""WITH {V.BEST}, {_expected(0)}, {V.IDS}, {V.TRUTH}, {_EV}, g AS (SELECT country, q % 2 AS odd, count(*) AS entities, sum(1 - {f05('tp', 'npred', 'ntrue')}) AS loss FROM ev JOIN ids USING (q) GROUP BY ALL)
SELECT country, odd, entities, round(loss, 6) AS loss, round(loss / sum(loss) OVER (), 6) AS share FROM g""")
def group_loss(spark, d):
    """I23."""
    all_ = V.pairs(spark, d)
    ids = V.ids(spark, d)
    n = metrics.entity_counts(decide.expected_f(decide.assign_best(all_)), V.truth(all_), ids).join(ids, "q").withColumn("odd", F.expr("q % 2"))
    return rounded(metrics.group_loss(n, ["country", "odd"]), "loss", "share")


_EDGES = [0.0, 0.1, 0.3, 0.5, 0.8]
_LAB = "lab AS (SELECT pairs.*, (gt.p IS NOT NULL)::INT AS y FROM pairs LEFT JOIN gt USING (q, p))"


def labelled(spark, d) -> DataFrame:
    all_ = V.pairs(spark, d)
    return sampling.label(all_, V.truth(all_))


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {_LAB}, b AS (SELECT src, y, CASE WHEN prob > 0 AND prob <= 0.1::DOUBLE THEN 0 WHEN prob > 0.1::DOUBLE AND prob <= 0.3::DOUBLE THEN 1 WHEN prob > 0.3::DOUBLE AND prob <= 0.5::DOUBLE THEN 2 WHEN prob > 0.5::DOUBLE AND prob <= 0.8::DOUBLE THEN 3 END::BIGINT AS k FROM lab)
SELECT src, k AS bin, count(*) AS n, round(avg(y), 6) AS rate FROM b WHERE k IS NOT NULL GROUP BY 1, 2""")
def binned_rate(spark, d):
    """One binned column by source."""
    return rounded(metrics.binned_rate(labelled(spark, d), "prob", _EDGES, "y", ["src"]), "rate")


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {_LAB}, r AS (SELECT 'prob' AS s, prob AS v, y FROM lab UNION ALL SELECT 'ce', ce, y FROM lab WHERE ce IS NOT NULL),
k AS (SELECT s, y, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS rk FROM r)
SELECT s AS score, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE / (sum(y) * sum(1 - y)), 6) AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM k GROUP BY s""")
def auc(spark, d):
    """H17."""
    x = labelled(spark, d)
    return rounded(metrics.auc(x, "prob", "y").withColumn("score", F.lit("prob")).unionByName(metrics.auc(x, "ce", "y").withColumn("score", F.lit("ce"))), "auc")


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {_LAB}, h AS (SELECT prob AS s, sum(y) AS pos, count(*) AS n FROM lab GROUP BY 1),
r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM h WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
l AS (SELECT avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END) AS logloss, avg((y = (prob >= 0.5)::INT)::INT) AS accuracy FROM (SELECT y, prob, greatest(0.000001::DOUBLE, least(0.999999::DOUBLE, prob)) AS c FROM lab))
SELECT (SELECT round(sum(pos * tp / al::DOUBLE) / sum(pos), 6) FROM r) AS ap, round(logloss, 6) AS logloss, round(accuracy, 6) AS accuracy FROM l""")
def ranking_scores(spark, d):
    """H18 over all pairs."""
    x = labelled(spark, d)
    return rounded(metrics.average_precision(x, "prob", "y").crossJoin(metrics.log_loss(x, "prob", "y")), "ap", "logloss", "accuracy")


@query(f"WITH {V.PAIRS} SELECT src, round(quantile_cont(prob, 0.25), 6) AS q25, round(quantile_cont(prob, 0.5), 6) AS q50, round(quantile_cont(prob, 0.9), 6) AS q90 FROM pairs GROUP BY src")
def quantiles(spark, d):
    """percentile() counts equal values before it sorts, so few distinct scores stay small."""
    return V.pairs(spark, d).groupBy("src").agg(*[F.round(F.percentile("prob", p), 6).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.9, "q90"))])


@query(f"WITH {V.PAIRS} SELECT q, count(*) FILTER (src = 2) AS n2, count(*) FILTER (src = 3) AS n3, count(DISTINCT country) AS countries, round(sum(prob), 6) AS total, round(max(prob), 6) AS best FROM pairs GROUP BY q")
def pivot_counts(spark, d):
    """G1-G4, G8."""
    return V.pairs(spark, d).groupBy("q").agg(F.count_if(F.col("src") == 2).alias("n2"), F.count_if(F.col("src") == 3).alias("n3"), F.countDistinct("country").alias("countries"), F.round(F.sum("prob"), 6).alias("total"), F.round(F.max("prob"), 6).alias("best"))


# ------------------------------------------------------------------ ensembles


def _runs(spark, d) -> list[DataFrame]:
    best = best_of(spark, d).select("q", "p", "prob", "prob2", "src")
    return [decide.threshold(best, 0.6).select("q", "p"), decide.threshold(best, 0.6, "prob2").select("q", "p"), best.where("prob >= 0.5 AND src = 2").select("q", "p"), best.where("prob + prob2 >= 1").select("q", "p")]


_RUNS = V.BEST + """, r0 AS (SELECT q, p FROM best WHERE prob >= 0.6), r1 AS (SELECT q, p FROM best WHERE prob2 >= 0.6), r2 AS (SELECT q, p FROM best WHERE prob >= 0.5 AND src = 2), r3 AS (SELECT q, p FROM best WHERE prob + prob2 >= 1),
rs AS (SELECT 0 AS r, * FROM r0 UNION ALL SELECT 1, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3)"""
_VOTE = """v AS (SELECT q, p, count(*) AS votes, max((r = 0)::INT) AS ref FROM rs GROUP BY q, p),
o AS (SELECT * FROM v WHERE votes >= 3 OR (votes = 2 AND ref = 1) QUALIFY row_number() OVER (PARTITION BY p ORDER BY votes DESC, ref DESC, q) = 1),
voted AS (SELECT q, p, votes FROM o SEMI JOIN (SELECT q, p FROM pairs WHERE comb >= 0.2) USING (q, p))"""


def _voted(spark, d):
    return ensemble.vote(_runs(spark, d), 0, 3, V.pairs(spark, d).where("comb >= 0.2"))


@query(f"WITH {_RUNS}, {_VOTE} SELECT * FROM voted")
def majority_vote(spark, d):
    """I27, F4, F11."""
    return _voted(spark, d)


@query(f"WITH {_RUNS}, {_VOTE} SELECT q, p, votes FROM voted ANTI JOIN (SELECT q, p FROM r3 ANTI JOIN r0 USING (q, p)) USING (q, p)")
def final_vote(spark, d):
    """I28, F5."""
    r = _runs(spark, d)
    return ensemble.without_suspects(_voted(spark, d), r[0], r[3])


@query(f"WITH {_RUNS}, {V.IDS} SELECT q, p FROM r0 JOIN ids USING (q) WHERE country IN ('c1', 'c3') UNION ALL SELECT q, p FROM r1 JOIN ids USING (q) WHERE country NOT IN ('c1', 'c3')")
def hybrid(spark, d):
    """I29, F13."""
    r = _runs(spark, d)
    return ensemble.hybrid(r[0], r[1], V.ids(spark, d), ["c1", "c3"])


@query(f"""WITH {_RUNS}, {V.IDS}, x AS (SELECT q, p, max(n) AS n, max(o) AS o FROM (SELECT q, p, 1 AS n, 0 AS o FROM r1 UNION ALL SELECT q, p, 0, 1 FROM r0) GROUP BY q, p),
e AS (SELECT q, count(*) FILTER (n > o) AS ad, count(*) FILTER (o > n) AS rm, sum(n) AS nn, sum(o) AS no FROM x GROUP BY q)
SELECT country, count(*) AS entities, count(*) FILTER (coalesce(ad, 0) + coalesce(rm, 0) > 0) AS changed, sum(coalesce(ad, 0))::BIGINT AS added, sum(coalesce(rm, 0))::BIGINT AS removed, round(avg((coalesce(nn, 0) = 0)::INT), 6) AS empty_new, round(avg((coalesce(no, 0) = 0)::INT), 6) AS empty_old FROM ids LEFT JOIN e USING (q) GROUP BY country""")
def compare_runs(spark, d):
    """I25."""
    r = _runs(spark, d)
    return rounded(ensemble.compare_runs(r[1], r[0], V.ids(spark, d)), "empty_new", "empty_old")


@query(f"WITH {_RUNS} SELECT votes, count(*) AS pairs FROM (SELECT q, p, count(*) AS votes FROM rs GROUP BY q, p) GROUP BY votes")
def vote_histogram(spark, d):
    """I26."""
    return ensemble.vote_histogram(_runs(spark, d))


@query(f"WITH {_RUNS}, {V.IDS}, n AS (SELECT count(*) AS n FROM ids) SELECT 'r' || r AS run, count(*) AS pairs, round(count(*) / any_value(n)::DOUBLE, 6) AS per_entity, round(1 - count(DISTINCT q) / any_value(n)::DOUBLE, 6) AS empty FROM rs, n GROUP BY r")
def run_summary(spark, d):
    """I26."""
    return rounded(ensemble.run_summary({f"r{k}": r for k, r in enumerate(_runs(spark, d))}, V.ids(spark, d)), "per_entity", "empty")


@query(f"WITH {_RUNS} SELECT CASE WHEN w = 1 THEN 'only_a' WHEN w = 2 THEN 'only_b' ELSE 'both' END AS part, count(*) AS pairs FROM (SELECT q, p, sum(w) AS w FROM (SELECT q, p, 1 AS w FROM r0 UNION ALL SELECT q, p, 2 FROM r1) GROUP BY q, p) GROUP BY 1")
def pair_sets(spark, d):
    """I31, F12."""
    r = _runs(spark, d)
    return ensemble.pair_sets(r[0], r[1])


@query(f"WITH {V.PAIRS} SELECT q, p, round(CASE WHEN ce8 IS NULL THEN prob ELSE 0.7::DOUBLE * prob + 0.3::DOUBLE * ce8 END, 6) AS prob FROM pairs")
def blend(spark, d):
    """H19, F2."""
    x = V.pairs(spark, d)
    return rounded(ensemble.blend(x.select("q", "p", "prob"), x.where("ce8 IS NOT NULL").select("q", "p", F.col("ce8").alias("p_ext")), 0.3), "prob")


@query(f"WITH {V.PAIRS} SELECT q, p, round(list_avg(list_filter([prob, ce, ce8], lambda x: x IS NOT NULL)), 6) AS mean FROM (SELECT coalesce(a.q, b.q) AS q, coalesce(a.p, b.p) AS p, a.prob, b.ce, a.ce8 FROM (SELECT * FROM pairs WHERE prob > 0.2) a FULL JOIN (SELECT q, p, ce FROM pairs WHERE ce IS NOT NULL) b ON a.q = b.q AND a.p = b.p)")
def merge_scores(spark, d):
    """F3."""
    x = V.pairs(spark, d)
    m = ensemble.merge_scores([x.where("prob > 0.2").select("q", "p", "prob", "ce8"), x.where("ce IS NOT NULL").select("q", "p", "ce")], ["prob", "ce", "ce8"])
    return rounded(m.select("q", "p", "mean"), "mean")


@query(f"WITH {V.PAIRS} SELECT a.q, a.p, round(0.5::DOUBLE * a.prob + 0.5::DOUBLE * coalesce(b.prob2, a.prob), 6) AS prob FROM pairs a LEFT JOIN (SELECT q, p, prob2 FROM pairs WHERE src = 3) b USING (q, p)")
def fallback_mean(spark, d):
    """H21."""
    x = V.pairs(spark, d)
    return rounded(ensemble.fallback(x.select("q", "p", "prob"), x.where("src = 3").select("q", "p", F.col("prob2").alias("prob"))), "prob")


_BAND = "band AS (SELECT * FROM pairs QUALIFY ce BETWEEN 0.3 AND 0.6 OR country IN ('c2') OR row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) <= 2)"


@query(f"WITH {V.PAIRS}, {_BAND} SELECT q, p FROM band")
def band(spark, d):
    """H22."""
    return ensemble.select_band(V.pairs(spark, d), 0.3, 0.6, ["c2"]).select("q", "p")


@query(f"WITH {V.PAIRS}, {_BAND} SELECT q, p, round(coalesce((b.prob + b.prob2) / 2, pairs.prob), 6) AS prob FROM pairs LEFT JOIN band b USING (q, p)")
def overlay(spark, d):
    """H23."""
    x = V.pairs(spark, d)
    c = ensemble.select_band(x, 0.3, 0.6, ["c2"]).select("q", "p", ((F.col("prob") + F.col("prob2")) / 2).alias("pc"))
    return rounded(ensemble.overlay(x.select("q", "p", "prob"), c), "prob")


# ------------------------------------------------------------------ samples and training sets


@query(f"WITH {V.PAIRS} SELECT DISTINCT q, {_HALF}::BIGINT AS fold, dense_rank() OVER (PARTITION BY country ORDER BY q)::BIGINT - 1 AS gid FROM pairs")
def folds(spark, d):
    """G11, G15, G16."""
    x = V.pairs(spark, d).select("q", "country").distinct()
    return x.select("q", sampling.fold(F.col("q")).alias("fold"), (F.dense_rank().over(Window.partitionBy("country").orderBy("q")) - 1).cast("long").alias("gid"))


@query(f"""WITH {V.PAIRS}, {V.IDS}, {V.TRUTH}, kept AS (SELECT q FROM ids WHERE {_MIX1.format(seed=9, a='q')} / 999983::DOUBLE < 0.2), own AS (SELECT DISTINCT p FROM gt SEMI JOIN kept USING (q)), pool AS (SELECT DISTINCT p FROM pairs)
SELECT 'a' AS side, q AS id FROM kept UNION ALL SELECT 'b', p FROM pool SEMI JOIN own USING (p) UNION ALL SELECT 'b', p FROM pool ANTI JOIN gt USING (p) WHERE {_MIX1.format(seed=10, a='p')} / 999983::DOUBLE < 0.2""")
def density_sample(spark, d):
    """G14, G18."""
    all_ = V.pairs(spark, d)
    a, b = sampling.density_sample(V.ids(spark, d), all_.select("p").distinct(), V.truth(all_), 0.2, 9)
    return a.select(F.lit("a").alias("side"), F.col("q").alias("id")).unionByName(b.select(F.lit("b").alias("side"), F.col("p").alias("id")))


@query(f"WITH {V.PAIRS} SELECT q, p FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob2 DESC, p) <= 8) WHERE prob2 >= 0.01")
def scoring_candidates(spark, d):
    """H7."""
    return sampling.candidates_to_score(V.pairs(spark, d), "prob2", 0.01, 8).select("q", "p")


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {_LAB}, h AS (SELECT * FROM lab WHERE y = 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) <= 6),
r AS (SELECT * FROM (SELECT * FROM lab WHERE y = 0) l ANTI JOIN h USING (q, p) QUALIFY row_number() OVER (PARTITION BY q ORDER BY {_MIX.format(seed=0, a='q', b='p')}, q, p) <= 2)
SELECT q, p, y::BIGINT AS y FROM (SELECT * FROM lab WHERE y = 1 UNION ALL SELECT * FROM h UNION ALL SELECT * FROM r)""")
def training_pairs(spark, d):
    """H8, H26."""
    return sampling.training_pairs(labelled(spark, d).select("q", "p", "prob", "y")).select("q", "p", F.col("y").cast("long").alias("y"))


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {_LAB}, s AS (SELECT DISTINCT q FROM lab WHERE coalesce((y = 1 AND ce < 0.1) OR (y = 0 AND ce > 0.97), false) OR {_MIX1.format(seed=4, a='q')} / 999983::DOUBLE < 0.05)
SELECT q, p, y::BIGINT AS y FROM lab SEMI JOIN s USING (q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY y DESC, abs(coalesce(ce, 0) - 0.5::DOUBLE), p) <= 12""")
def mined_groups(spark, d):
    """H13, M13."""
    return sampling.mine_groups(labelled(spark, d), 0.97, 0.1, 0.05, 12, 4).select("q", "p", F.col("y").cast("long").alias("y"))


@query(f"""WITH {V.BEST}, s AS (SELECT q, p FROM best WHERE prob >= 0.7), n AS (SELECT pairs.*, s.q IS NOT NULL AS sel FROM pairs LEFT JOIN s USING (q, p) WHERE country NOT IN ('c0', 'c1')),
pos AS (SELECT q, p, 1 AS y FROM n WHERE sel AND prob >= 0.9 AND ce >= 0.9), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY q ORDER BY prob DESC, p) <= 8),
neg AS (SELECT q, p FROM t WHERE NOT sel AND prob <= 0.2 AND (ce IS NULL OR ce <= 0.2) QUALIFY row_number() OVER (PARTITION BY q ORDER BY {_MIX.format(seed=0, a='q', b='p')}, q, p) <= 3)
SELECT q, p, y::BIGINT AS y FROM pos UNION ALL SELECT q, p, 0 FROM neg WHERE {_MIX.format(seed=3, a='q', b='p')} / 999983::DOUBLE < least(1, (SELECT count(*) FROM pos) / (SELECT count(*) FROM neg)::DOUBLE)""")
def pseudo_labels(spark, d):
    """H24."""
    x = V.pairs(spark, d)
    known = spark.createDataFrame([("c0",), ("c1",)], "country string")
    return sampling.pseudo_labels(x, decide.threshold(decide.assign_best(x), 0.7), known).select("q", "p", F.col("y").cast("long").alias("y"))


@query(f"""WITH {V.PAIRS}, k AS (SELECT * FROM pairs WHERE {_MIX1.format(seed=2, a='q')} / 999983::DOUBLE >= 0.25)
SELECT q, p, count(*) OVER (PARTITION BY p) AS p_n, rank() OVER (PARTITION BY p ORDER BY comb DESC)::BIGINT AS p_rank_comb FROM k""")
def dropped_entities(spark, d):
    """Context features after a share of the entities has gone."""
    x = sampling.drop_entities(V.pairs(spark, d), 0.25, 2)
    return competition.context_features(x, ("comb",)).select("q", "p", "p_n", "p_rank_comb")


@query(f"""WITH {V.PAIRS}, {V.TRUTH}, {_LAB}, n AS (SELECT q, sum(CASE WHEN y = 0 THEN exp(prob) ELSE 0 END) AS neg FROM lab GROUP BY q)
SELECT q AS gid, round(avg(-(prob - ln(exp(prob) + neg))), 6) AS loss, round(avg(1 / (1 + exp(coalesce(ln(1 - prob2 + 0.01), -30) - coalesce(ln(prob2 + 0.01), -30)))), 6) AS judged FROM lab JOIN n USING (q) WHERE y = 1 GROUP BY q""")
def listwise_loss(spark, d):
    """H12, H16."""
    x = labelled(spark, d).withColumns({"yes": F.log(F.col("prob2") + 0.01), "no": F.log(1 - F.col("prob2") + 0.01)})
    loss = models.info_nce(x.select(F.col("q").alias("gid"), F.col("prob").alias("s"), "y"))
    judged = x.where("y = 1").groupBy(F.col("q").alias("gid")).agg(F.avg(models.judge_probability("yes", "no")).alias("judged"))
    return rounded(loss.join(judged, "gid"), "loss", "judged")


# ------------------------------------------------------------------ text and blocking


@query("""WITH n AS (SELECT p_partkey AS id, lower(regexp_replace(p_name || ' & Co. dba ' || p_type || ' 0' || p_size, '\\(\\s*id\\s*:?\\s*\\d+\\s*\\)', ' ', 'g')) AS s FROM part),
a AS (SELECT id, regexp_replace(replace(replace(list_extract(string_split(s, ' dba '), -1), '&', ' and '), '.', ''), '[^a-z0-9 ]+', ' ', 'g') AS c FROM n)
SELECT id, array_to_string(list_filter(string_split(c, ' '), lambda x: x <> ''), ' ') AS norm, array_to_string(list_transform(regexp_extract_all(c, '\\d+'), lambda x: regexp_replace(x, '^0+(\\d)', '\\1')), ' ') AS nums, 1::BIGINT AS has_alias FROM a""")
def name_parts(spark, d):
    """Alias clause, symbols, number runs."""
    raw = F.concat(F.col("p_name"), F.lit(" & Co. dba "), F.col("p_type"), F.lit(" 0"), F.col("p_size").cast("string"))
    x = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(raw).alias("raw"), F.lit("").alias("ctry"))
    cols = text.name_columns(F.col("raw"), F.col("ctry"), ascii_fn=lambda c: c)
    for name, c in cols.items():
        x = x.withColumn(name, c)
        if name == "_clean":
            break
    toks_ = text.tokens(F.col("_clean"))
    return x.select("id", F.array_join(toks_, " ").alias("norm"), F.array_join(F.transform(F.regexp_extract_all("_clean", F.lit(r"\d+"), F.lit(0)), text.strip_zeros), " ").alias("nums"), F.col("has_alias").cast("long").alias("has_alias"))


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS t FROM documents)
SELECT t, CASE WHEN length(regexp_replace(t, '[^a-z]', '', 'g')) >= 3 AND length(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 THEN translate(t, '0134578', 'oieastb') ELSE t END AS deleet, regexp_replace(t, '^0+(\\d)', '\\1') AS zeros FROM t""")
def token_rules(spark, d):
    """B10, B18, B25 over all tokens of the documents."""
    plain = text.strip_accents(F.col("text"))
    t = V.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), F.lit(0))).alias("t")).distinct()
    return t.select("t", text.deleet(F.col("t")).alias("deleet"), text.strip_zeros(F.col("t")).alias("zeros"))


@query("""SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[^\\s!-/:-@\\[-`{-~]+'))::BIGINT AS n_words, regexp_matches(text, '[^\\x00-\\x7F]')::BIGINT AS non_ascii FROM documents""")
def word_counts(spark, d):
    """B1, B21."""
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(text.words(F.col("text"))).cast("long").alias("n_words"), text.non_ascii(F.col("text")).cast("long").alias("non_ascii"))


@query()
def normalized(spark, d):
    """The whole normaliser, with its romanisation UDF."""
    x = V.records(spark, d).select(F.col("id").cast("string").alias("entity_id"), F.concat(F.col("name_key"), F.lit(" Pvt. Ltd")).alias("business_name"), F.col("addr_norm").alias("business_address"), "country")
    return text.normalize(x)


_GRAMS = "list_transform(range(1, greatest(1, length(w) - 2) + 1), lambda i: substring(w, i, 3))"


def _tfidf(name, src, max_df):
    return f"""{name}_tf AS (SELECT country, side, id, term, count(*) AS tf FROM {src} GROUP BY ALL),
{name}_n AS (SELECT country, count(*) AS n FROM records GROUP BY country),
{name}_df AS (SELECT country, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT country, term, count(*) AS df FROM {name}_tf GROUP BY ALL) JOIN {name}_n USING (country) WHERE df >= 2{f' AND df <= {max_df}::DOUBLE * n' if max_df else ''}),
{name}_w AS (SELECT country, side, id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM {name}_tf JOIN {name}_df USING (country, term)),
{name} AS (SELECT country, side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, side, id)) AS w FROM {name}_w)"""


_TERMS = f"""gr AS (SELECT country, side, id, unnest({_GRAMS}) AS term FROM (SELECT country, side, id, ' ' || unnest(list_filter(string_split(name_key, ' '), lambda x: x <> '')) || ' ' AS w FROM records)),
wo AS (SELECT country, side, id, unnest(list_filter(string_split(addr_norm, ' '), lambda x: x <> '')) AS term FROM records)"""


def _dots(name, where=""):
    return f"(SELECT a.country, a.id AS q, b.id AS p, round(sum(a.w * b.w), 9) AS sim FROM {name} a JOIN {name} b ON a.country = b.country AND a.term = b.term WHERE a.side = 'a' AND b.side = 'b'{where} GROUP BY ALL)"


_BLOCK = f"""{V.RECORDS}, {_TERMS}, {_tfidf('nm', 'gr', 0.05)}, {_tfidf('ad', 'wo', 0.3)},
jo AS (SELECT country, side, id, 'n:' || term AS term, w * sqrt(0.4::DOUBLE) AS w FROM nm UNION ALL SELECT country, side, id, 'a:' || term, w * sqrt(0.6::DOUBLE) FROM ad),
nd AS {_dots('nm')}, adt AS {_dots('ad')}, jd AS {_dots('jo')},
un AS (SELECT country, q, p FROM (SELECT * FROM jd WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) <= 40) UNION SELECT country, q, p FROM (SELECT * FROM nd WHERE sim > 0.1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) <= 10)),
cands AS (SELECT un.country, un.q, un.p, coalesce(nd.sim, 0) AS name_cos, coalesce(adt.sim, 0) AS addr_cos, round(0.4::DOUBLE * coalesce(nd.sim, 0) + 0.6::DOUBLE * coalesce(adt.sim, 0), 9) AS comb FROM un LEFT JOIN nd ON nd.q = un.q AND nd.p = un.p LEFT JOIN adt ON adt.q = un.q AND adt.p = un.p)"""


def _blocked(spark, d):
    return blocking.block(V.records(spark, d))


@query(f"WITH {_BLOCK} SELECT country, q, p, round(name_cos, 6) AS name_cos, round(addr_cos, 6) AS addr_cos, round(comb, 6) AS comb FROM cands")
def block(spark, d):
    """C1-C9, M12."""
    return rounded(_blocked(spark, d), "name_cos", "addr_cos", "comb")


_RESCUE = f"""{_tfidf('rn', 'gr', None)}, rsc AS (SELECT * FROM {_dots('rn', " AND b.id IN (SELECT id FROM records WHERE addr_norm = '')")} WHERE sim > 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) <= 20)"""


@query(f"""WITH {_BLOCK}, {_RESCUE} SELECT country, q, p, round(name_cos, 6) AS name_cos, round(comb, 6) AS comb FROM (SELECT country, q, p, name_cos, comb FROM cands UNION ALL SELECT country, q, p, sim, round(0.4::DOUBLE * sim, 9) FROM rsc ANTI JOIN cands USING (q, p))""")
def block_with_rescue(spark, d):
    """C10, C11, C13."""
    n = V.records(spark, d)
    x = blocking.add_rescue(_blocked(spark, d), blocking.rescue_empty_address(n))
    return rounded(x.select("country", "q", "p", "name_cos", "comb"), "name_cos", "comb")


@query(f"""WITH {_BLOCK}, gt AS (SELECT a.id AS q, b.id AS p FROM records a JOIN records b ON a.country = b.country AND a.name_key = b.name_key WHERE a.side = 'a' AND b.side = 'b')
SELECT round(avg((c.q IS NOT NULL)::INT), 6) AS recall, (SELECT count(*) FROM cands) AS pairs, round(1 - (SELECT count(*) FROM cands) / ((SELECT count(*) FROM records WHERE side = 'a')::DOUBLE * (SELECT count(*) FROM records WHERE side = 'b')), 6) AS reduction FROM gt LEFT JOIN cands c ON c.q = gt.q AND c.p = gt.p""")
def blocking_recall(spark, d):
    """C14."""
    n = V.records(spark, d)
    key = lambda s, o: n.where(f"side = '{s}'").select("country", "name_key", F.col("id").alias(o))
    truth = key("a", "q").join(key("b", "p"), ["country", "name_key"]).select("q", "p")
    return rounded(blocking.recall(_blocked(spark, d), truth, n), "recall", "reduction")


# ------------------------------------------------------------------ pair and record features


def _texts(spark, d):
    n = V.records(spark, d)
    side = lambda s: n.select(F.col("id").alias(s), F.col("name_key").alias(f"{s}n"), F.col("addr_norm").alias(f"{s}a"))
    return _record_pairs(spark, d).join(side("q"), "q").join(side("p"), "p")


@query(f"""WITH {_RP} SELECT q, p, (split_part(a.name_key, ' ', 1) = split_part(b.name_key, ' ', 1))::INT::DOUBLE AS n_first_eq, round({_JAC.format(a=toks('a.name_key'), b=toks('b.name_key'))}, 6) AS n_jacc, round({_JAC.format(a=toks('a.addr_norm'), b=toks('b.addr_norm'))}, 6) AS a_jacc,
(length(b.name_key) - length(a.name_key))::DOUBLE AS n_len_diff FROM rp JOIN records a ON a.id = q JOIN records b ON b.id = p""")
def token_features(spark, d):
    """E9, E10, E13, E17, E29."""
    x, first = _texts(spark, d), lambda c: F.substring_index(c, " ", 1)
    return rounded(x.select("q", "p", (first("qn") == first("pn")).cast("double").alias("n_first_eq"), strsim.jaccard(text.tokens(F.col("qn")), text.tokens(F.col("pn"))).alias("n_jacc"), strsim.jaccard(text.tokens(F.col("qa")), text.tokens(F.col("pa"))).alias("a_jacc"), (F.length("pn") - F.length("qn")).cast("double").alias("n_len_diff")), "n_jacc", "a_jacc")


@query(f"WITH {_RP} SELECT q, p, round(jaro_winkler_similarity(replace(strip_accents(a.name_key), 'ß', 'ss'), replace(strip_accents(b.name_key), 'ß', 'ss')), 6) AS jw FROM rp JOIN records a ON a.id = q JOIN records b ON b.id = p WHERE a.name_key <> '' AND b.name_key <> ''")
def jaro_winkler(spark, d):
    """E6; accents go first, as the other engine compares bytes."""
    plain = lambda c: F.replace(text.strip_accents(F.col(c)), F.lit("ß"), F.lit("ss"))
    return rounded(_texts(spark, d).where("qn <> '' AND pn <> ''").select("q", "p", strsim.jaro_winkler(plain("qn"), plain("pn")).alias("jw")), "jw")


def _numbers(spark, d):
    """Digit strings of orders and parts: what number features compare."""
    p = V.pairs(spark, d).select("q", "p")
    arr = lambda a, b: F.array(F.col(a).cast("string"), (F.col(b) % 1000).cast("string"))
    return p.select("q", "p", arr("q", "p").alias("a"), arr("p", "q").alias("b"))


_NUM = "nx AS (SELECT q, p, [q::VARCHAR, (p % 1000)::VARCHAR] AS a, [p::VARCHAR, (q % 1000)::VARCHAR] AS b FROM pairs), nf AS (SELECT *, list_distinct(a) AS da, list_distinct(b) AS db FROM nx)"


@query(f"""WITH {V.PAIRS}, {_NUM} SELECT q, p, round(len(list_intersect(da, db))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS num_jacc, (a[1] = b[1])::INT::DOUBLE AS num_first_eq, len(list_intersect(da, db))::DOUBLE AS num_common,
(list_bool_or(flatten(list_transform(a, lambda x: list_transform(b, lambda y: x <> y AND least(length(x), length(y)) >= 2 AND (starts_with(x, y) OR starts_with(y, x) OR suffix(x, y) OR suffix(y, x)))))))::INT::DOUBLE AS num_fix,
round(ln(1 + list_min(flatten(list_transform(list_filter(a, lambda x: length(x) <= 6), lambda x: list_transform(list_filter(b, lambda y: length(y) <= 6), lambda y: abs(x::BIGINT - y::BIGINT)))))::DOUBLE), 6) AS num_house_diff FROM nf""")
def number_features(spark, d):
    """E18-E20, E22, E27."""
    x = _numbers(spark, d)
    return rounded(x.select("q", "p", *[c.alias(n) for n, c in strsim.number_features(F.col("a"), F.col("b")).items() if n != "post_eq"]), "num_jacc", "num_house_diff")


@query()
def string_features(spark, d):
    """E1-E30 over blocked candidates of the records (the first words of each text, see views.records)."""
    n = V.records(spark, d)
    base = n.select("id", F.col("name_key").alias("name_norm"), F.col("name_key").alias("name_core"), "name_key", F.replace("name_key", F.lit(" "), F.lit("")).alias("name_sq"), F.lit("").alias("legal"), "addr_norm", F.array_join(F.regexp_extract_all("addr_norm", F.lit(r"\d+"), F.lit(0)), " ").alias("nums"), *[F.lit(0).alias(c) for c in ("is_domain", "non_ascii", "has_alias")], (F.col("addr_norm") == "").cast("int").alias("addr_empty"), "src")
    return rec.pair_features(_blocked(spark, d).select("q", "p"), base, base)


@query(f"""WITH {V.RECORDS}, t AS (SELECT id, country, side, unnest(list_filter(string_split(name_key, ' '), lambda x: x <> '')) AS t FROM records), v AS (SELECT DISTINCT country, t FROM t WHERE side = 'a'),
g AS (SELECT id, count(*) AS n, count(*) FILTER (v.t IS NULL) AS miss FROM t LEFT JOIN v USING (country, t) WHERE side = 'b' GROUP BY id)
SELECT records.id, coalesce(n, 0) AS b_n_tok, round(coalesce(miss / n::DOUBLE, 0), 6) AS b_oov_frac, coalesce((n > 0 AND miss = n)::INT, 0)::BIGINT AS b_oov_all FROM records LEFT JOIN g USING (id) WHERE side = 'b'""")
def unknown_words(spark, d):
    """E31."""
    n = V.records(spark, d)
    return rounded(rec.unknown_words(n.where("side = 'b'"), n.where("side = 'a'")), "b_oov_frac")


@query(f"""WITH {V.RECORDS}, na AS (SELECT country, name_key, count(*) AS c FROM records WHERE side = 'a' GROUP BY ALL), aa AS (SELECT country, addr_norm, count(*) AS c FROM records WHERE side = 'a' GROUP BY ALL)
SELECT id, coalesce(na.c, 0) AS b_name_s1_cnt, CASE WHEN r.addr_norm <> '' THEN coalesce(aa.c, 0) END AS b_addr_s1_cnt FROM records r LEFT JOIN na USING (country, name_key) LEFT JOIN aa ON aa.country = r.country AND aa.addr_norm = r.addr_norm WHERE side = 'b'""")
def key_counts(spark, d):
    """E32."""
    n = V.records(spark, d)
    x = rec.key_counts(n.where("side = 'b'"), n.where("side = 'a'"), "name_key", "b_name_s1_cnt")
    return rec.key_counts(x, n.where("side = 'a'"), "addr_norm", "b_addr_s1_cnt", True).select("id", "b_name_s1_cnt", "b_addr_s1_cnt")


_SIM = "(1 - abs(({a} * 13) % 101 - ({b} * 13) % 101) / 101::DOUBLE)"


@query(f"""WITH {V.PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prob2 DESC, p) AS rk FROM pairs QUALIFY rk <= 6),
b AS (SELECT i.q, i.p, i.src AS s, j.src AS js, j.prob2 AS jp, j.rk AS jr, {_SIM.format(a='i.p', b='j.p')} AS n, {_SIM.format(a='(i.p + 5)', b='(j.p + 5)')} AS a FROM t i JOIN t j ON i.q = j.q AND i.p <> j.p),
g AS (SELECT q, p, max(n) AS nm, max(a) AS am, arg_max(jp, n * 1000000 - jr) AS pb, count(*) FILTER (n >= 0.8 OR a >= 0.9) AS ns, sum(jp * greatest(n, a)) AS w, max(CASE WHEN s <> js THEN n ELSE 0 END) AS o FROM b GROUP BY q, p)
SELECT q, p, round(nm, 6) AS sup_name_max, round(am, 6) AS sup_addr_max, round(pb, 6) AS sup_prob_of_best, ns AS sup_n_similar, round(w, 6) AS sup_weighted, round(o, 6) AS sup_other_src_name_max FROM pairs LEFT JOIN g USING (q, p)""")
def support(spark, d):
    """All-pairs support among the best six of an entity, with a whole-number similarity."""
    x = V.pairs(spark, d).select("q", "p", "src", "prob2", F.expr("(p * 13) % 101").alias("name"), F.expr("((p + 5) * 13) % 101").alias("addr"))
    s = rec.support(x, lambda a, b: 1 - F.abs(a - b) / F.lit(101.0))
    return rounded(s, "sup_name_max", "sup_addr_max", "sup_prob_of_best", "sup_weighted", "sup_other_src_name_max").drop("src", "prob2", "name", "addr")


# ------------------------------------------------------------------ transliteration and synthetic records

_RPT = """tx AS (SELECT [w0 for w0 in list_distinct(regexp_extract_all(lower(b.name_key), '[^\\s!-/:-@\\[-`{-~]+')) if regexp_matches(w0, '[^\\x00-\\x7F]')] AS f, list_distinct(regexp_extract_all(lower(a.name_key), '[^\\s!-/:-@\\[-`{-~]+')) AS e FROM rp JOIN records a ON a.id = q JOIN records b ON b.id = p
  UNION ALL SELECT [w0 for w0 in list_distinct(regexp_extract_all(lower(b.addr_norm), '[^\\s!-/:-@\\[-`{-~]+')) if regexp_matches(w0, '[^\\x00-\\x7F]')], list_distinct(regexp_extract_all(lower(a.addr_norm), '[^\\s!-/:-@\\[-`{-~]+')) FROM rp JOIN records a ON a.id = q JOIN records b ON b.id = p),
tn AS (SELECT unnest(f) AS src, e FROM tx WHERE len(f) > 0)"""


@query(f"""WITH {_RP}, {_RPT}, tot AS (SELECT src, count(*) AS n FROM tn GROUP BY src HAVING count(*) >= 2), pr AS (SELECT src, dst, count(*) AS c FROM (SELECT src, unnest(e) AS dst FROM tn) WHERE NOT regexp_matches(dst, '^\\d+$') GROUP BY ALL),
sc AS (SELECT src, dst, round(c / n::DOUBLE * (0.5::DOUBLE + length(dst) / (length(dst) + abs(length(dst) - length(src)))::DOUBLE), 9) AS score FROM pr JOIN tot USING (src))
SELECT src, dst, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) = 1 AND score >= 0.3""")
def learn_transliteration(spark, d):
    """B24, M11, with a length ratio for the sound of words."""
    n = V.records(spark, d)
    side = lambda o, s: n.select(F.col("id").alias(o), F.col("name_key").alias(f"{s}_name"), F.col("addr_norm").alias(f"{s}_addr"))
    x = _record_pairs(spark, d).join(side("q", "a"), "q").join(side("p", "b"), "p")
    length = lambda a, b: F.length(b) / (F.length(b) + F.abs(F.length(b) - F.length(a)))
    return rounded(translit.learn(x, length, 2, 0.3), "score")


def _named(spark, d) -> DataFrame:
    return V.records(spark, d).select("id", "country", F.col("name_key").alias("name"), F.col("addr_norm").alias("addr"))


@query()
def synthetic_pairs(spark, d):
    """I34, I35."""
    return synth.labelled_pairs(_named(spark, d))


@query()
def synthetic_world(spark, d):
    """The pool. Copies as many as true pairs have, decoys of both sources that no record of side a resembles."""
    n = _named(spark, d)
    own, pool = n.where("id % 3 = 0").drop("country"), n.where("id % 3 <> 0").select(F.col("id").alias("p"), "name", "addr", F.expr("1 + id % 3").alias("src"))
    known = V.truth(V.pairs(spark, d)).groupBy("q").agg(F.count_if(F.expr("p % 2 = 0")).alias("n2"), F.count_if(F.expr("p % 2 <> 0")).alias("n3"))
    found = _blocked(spark, d).select("p", F.col("comb").alias("prob"))
    counts = synth.copy_counts(own.select(F.col("id").alias("q")), known)
    return synth.world(own, synth.unowned(pool, found, own, 0.02, 0.3), counts)[1]


@query()
def synthetic_french(spark, d):
    """Noisy French records, the next record's name as the other owner."""
    n = _named(spark, d).where("country = 'fr'")
    w = Window.partitionBy(F.floor(F.col("id") / 1000)).orderBy("id")
    return synth.add_french_noise(n.withColumn("other", F.lead("name").over(w)))


@query()
def synthetic_groups(spark, d):
    """I37."""
    return synth.groups(_named(spark, d))


# ------------------------------------------------------------------ models


@query()
def two_fold_scores(spark, d):
    """H1-H6: out-of-fold boosted scores of labelled pairs, validation rows by both models."""
    x = labelled(spark, d).withColumns({"fold": sampling.fold(F.col("q")), "val": sampling.uniform(F.col("q"), seed=1) < 0.1, "y": F.col("y").cast("double")})
    _, scored = models.two_fold(x.select("q", "p", "prob", "ce", "comb", "fold", "val", "y"), lambda: models.Boosted(["prob", "ce", "comb"], 3, 3), out="score")
    return rounded(scored.select("q", "p", "score"), "score")
