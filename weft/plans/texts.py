"""Queries over normalised records and string kernels, each with the DuckDB SQL that gives the same rows.

Sequence kernels are repeated in SQL by a recursive row of the longest common subsequence, over short strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strsim, tables, text
from ..operators import records as rec
from ..sources import lists
from . import queries as Q
from . import views as V
from .queries import query, rounded
from .tuning import _POOL, _pool

# ------------------------------------------------------------------ the normaliser


def _variants(spark, d) -> DataFrame:
    """Parts as raw records of four countries, with tags, aliases, domains, legal forms, typing errors and states."""
    name = """CASE p_partkey % 8 WHEN 0 THEN concat(p_name, '\\u200b Pvt. Ltd') WHEN 1 THEN concat(p_name, ' (ID: ', p_partkey, ')') WHEN 2 THEN concat('Old ', p_type, ' dba ', p_name, ' & Sons') WHEN 3 THEN concat('M/s. ', p_name, ' + Co')
WHEN 4 THEN concat('www.', replace(p_name, ' ', '-'), '.com') WHEN 5 THEN concat('The ', replace(p_name, 'e', '3'), ' Tech Svcs Inc') WHEN 6 THEN concat('Ets ', p_name, ' SARL') ELSE concat(p_name, ' doing business as ', p_type, ' Private Limited') END"""
    addr = """CASE p_partkey % 7 WHEN 0 THEN concat(p_partkey, ' Ste Anne St., Ciy Flor 2, TX') WHEN 1 THEN concat('00', p_partkey, ' Main Rd, Apt 5, N/A') WHEN 2 THEN concat('No. ', p_partkey, ' ', p_name, ' Ave, KA')
WHEN 3 THEN '' WHEN 4 THEN concat(p_partkey, ' r. du Moulin, Nord, France') WHEN 5 THEN concat('Plot ', p_partkey, ', Opp mkt, MH') ELSE concat('9021', p_partkey, ' First Bd') END"""
    country = "element_at(array('US', 'India', 'France', 'Germany'), int(p_partkey % 4) + 1)"
    return V.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.expr(name).alias("business_name"), F.expr(addr).alias("business_address"), F.expr(country).alias("country"))


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _get(table: dict[str, str], key: str) -> str:
    return f"list_extract(map_extract({_map(table)}, {key}), 1)"


def _once(c: str) -> str:
    """Runs of one character become one."""
    return f"array_to_string(list_transform(list_filter(range(1, length({c}) + 1), lambda i: i = 1 OR substr({c}, i, 1) <> substr({c}, i - 1, 1)), lambda i: substr({c}, i, 1)), '')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_FORM = f"coalesce({_get(tables.LEGAL, 'x')}, {_get(tables.LEGAL, _once('x'))})"
_LONG = f"coalesce(CASE WHEN c = 'france' THEN {_get(tables.FR_NAME_ABBR, 'x')} END, {_get(tables.NAME_ABBR, 'x')}, x)"
_DELEET = "CASE WHEN length(regexp_replace(x, '[^a-z]', '', 'g')) >= 3 AND length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 THEN translate(x, '0134578', 'oieastb') ELSE x END"
_ADDR = f"coalesce(CASE WHEN c = 'france' THEN {_get(tables.FR_ADDR_ABBR, 'x')} END, {_get(tables.ADDR_ABBR, 'x')}, x)"
_STATE = f"coalesce(CASE WHEN c = 'us' THEN {_get(tables.US_STATES, 'x')} WHEN c = 'india' THEN {_get(tables.IN_STATES, 'x')} END, x)"

NORMALIZED = f"""raw AS (SELECT p_partkey::VARCHAR AS entity_id,
  CASE p_partkey % 8 WHEN 0 THEN p_name || chr(8203) || ' Pvt. Ltd' WHEN 1 THEN p_name || ' (ID: ' || p_partkey || ')' WHEN 2 THEN 'Old ' || p_type || ' dba ' || p_name || ' & Sons' WHEN 3 THEN 'M/s. ' || p_name || ' + Co'
    WHEN 4 THEN 'www.' || replace(p_name, ' ', '-') || '.com' WHEN 5 THEN 'The ' || replace(p_name, 'e', '3') || ' Tech Svcs Inc' WHEN 6 THEN 'Ets ' || p_name || ' SARL' ELSE p_name || ' doing business as ' || p_type || ' Private Limited' END AS name,
  CASE p_partkey % 7 WHEN 0 THEN p_partkey || ' Ste Anne St., Ciy Flor 2, TX' WHEN 1 THEN '00' || p_partkey || ' Main Rd, Apt 5, N/A' WHEN 2 THEN 'No. ' || p_partkey || ' ' || p_name || ' Ave, KA'
    WHEN 3 THEN '' WHEN 4 THEN p_partkey || ' r. du Moulin, Nord, France' WHEN 5 THEN 'Plot ' || p_partkey || ', Opp mkt, MH' ELSE '9021' || p_partkey || ' First Bd' END AS addr,
  lower(['US', 'India', 'France', 'Germany'][p_partkey % 4 + 1]) AS c FROM part),
m1 AS (SELECT *, regexp_replace(name, '[​-‏⁠﻿­]', '', 'g') AS plain FROM raw),
m2 AS (SELECT *, regexp_split_to_array(regexp_replace(lower(plain), '\\(\\s*id\\s*:?\\s*\\d+\\s*\\)', ' ', 'g'), '{_sql(text.ALIAS)}') AS pt FROM m1),
m3 AS (SELECT *, regexp_replace(pt[-1], '^\\s*m\\s*/\\s*s\\b\\.?', ' ') AS n FROM m2),
m4 AS (SELECT *, regexp_matches(n, '{_sql(text.DOMAIN)}') AS dm FROM m3),
m5 AS (SELECT *, regexp_replace(replace(replace(replace(CASE WHEN dm THEN replace(regexp_extract(n, '{_sql(text.DOMAIN)}', 1), '-', ' ') ELSE n END, '&', ' and '), '+', ' plus '), '.', ''), '[^a-z0-9 ]+', ' ', 'g') AS cl FROM m4),
m6 AS (SELECT *, list_transform(list_filter(string_split(cl, ' '), lambda x: x <> ''), lambda x: {_DELEET}) AS t FROM m5),
m7 AS (SELECT *, list_transform(t, lambda x: coalesce({_FORM}, {_LONG})) AS nn,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(t, lambda x: {_FORM} IS NOT NULL), lambda x: string_split({_FORM}, ' '))))), ' '), '') AS legal,
  list_filter(list_transform(list_filter(t, lambda x: {_FORM} IS NULL), lambda x: {_LONG}), lambda x: x NOT IN {_in(tables.FILLER)}) AS co FROM m6),
m8 AS (SELECT *, array_to_string(nn, ' ') AS name_norm, array_to_string(CASE WHEN len(co) > 0 THEN co ELSE nn END, ' ') AS name_core FROM m7),
m9 AS (SELECT *, {_once('name_core')} AS name_key FROM m8),
a1 AS (SELECT *, string_split(replace(regexp_replace(lower(addr), '\\bn\\s*/\\s*a\\b', ' ', 'g'), '.', ''), ',') AS cp FROM m9),
a2 AS (SELECT *, list_transform(cp, lambda x: trim(regexp_replace(regexp_replace(x, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS cq FROM a1),
a3 AS (SELECT *, array_to_string(list_transform(list_filter(cq, lambda x: NOT (c = 'france' AND x IN {_in(tables.FR_DROP_COMPONENTS)})), lambda x: {_STATE}), ' ') AS ad FROM a2),
a4 AS (SELECT *, list_transform(list_transform(list_filter(string_split(ad, ' '), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN regexp_replace(x, '^0+(\\d)', '\\1') ELSE x END), lambda x: {_ADDR}) AS ex FROM a3),
a5 AS (SELECT *, coalesce(array_to_string(list_filter(ex, lambda x: x NOT IN {_in(tables.ADDR_DROP)}), ' '), '') AS addr_norm FROM a4),
norm AS (SELECT entity_id, c AS country, regexp_matches(plain, '[^\\x00-\\x7F]')::INT AS non_ascii, (len(pt) > 1)::INT AS has_alias, dm::INT AS is_domain, legal, name_norm, name_core, name_key, replace(name_key, ' ', '') AS name_sq, addr_norm,
  coalesce(array_to_string(list_transform(regexp_extract_all(addr_norm, '\\d+'), lambda x: regexp_replace(x, '^0+(\\d)', '\\1')), ' '), '') AS nums, (addr_norm = '')::INT AS addr_empty FROM a5)"""


def _normal(spark, d) -> DataFrame:
    return text.normalize(_variants(spark, d), ascii_fn=F.lower)


@query(f"WITH {NORMALIZED} SELECT * FROM norm")
def normalized_parts(spark, d):
    """The whole normaliser, with lower case for romanisation."""
    return _normal(spark, d)


def _accents(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit("e"), F.lit("é")).alias("name"), F.concat(F.replace("p_name", F.lit("e"), F.lit("é")), F.lit(", "), F.col("p_name")).alias("addr"))
    known = rows.select(F.explode(F.split("name", " ")).alias("src")).where("length(src) % 2 = 0").distinct().select("src", F.upper(F.replace("src", F.lit("é"), F.lit("ee"))).alias("dst"))
    return rows, known


_TL = "list_transform(string_split({c}, ' '), lambda w: CASE WHEN length(w) % 2 = 0 THEN upper(replace(w, 'é', 'ee')) ELSE w END)"


@query(f"""WITH r AS (SELECT p_partkey AS id, p_name AS n, replace(p_name, 'e', 'é') AS e FROM part), t AS (SELECT *, array_to_string({_TL.format(c='e')}, ' ') AS done FROM r)
SELECT id, CASE WHEN contains(e, 'é') THEN done ELSE e END AS name, CASE WHEN contains(e, 'é') THEN done ELSE e END || ', ' || n AS addr FROM t""")
def transliterated(spark, d):
    """Learnt words replaced, in whole names and in those address components that go beyond ASCII."""
    rows, known = _accents(spark, d)
    return text.transliterate(text.transliterate(rows, "name", known), "addr", known, True)


# ------------------------------------------------------------------ string kernels

_LCS = """lc AS (SELECT a, b, 0::BIGINT AS k, list_transform(range(length(a) + 1), lambda z: 0::BIGINT) AS r FROM kp
  UNION ALL SELECT a, b, k + 1, list_transform(range(1, length(a) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN i = 1 THEN 0 WHEN substr(a, i - 1, 1) = substr(b, k + 1, 1) THEN r[i - 1] + 1 ELSE r[i] END))) FROM lc WHERE k < length(b)),
kl AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100 ELSE 200 * r[length(a) + 1] / (length(a) + length(b))::DOUBLE END AS ratio FROM lc WHERE k = length(b))"""
_SETS = "list_filter(string_split({c}, ' '), lambda z: z <> '')"


def _sorted(c: str) -> str:
    return f"coalesce(array_to_string(list_sort({_SETS.format(c=c)}), ' '), '')"


def _set_parts(src: str, a: str, b: str) -> str:
    """ts: of distinct pairs (a, b) of src the sorted common words and what only one side has; tp: the pairs to compare."""
    x, y = (f"list_sort(list_distinct({_SETS.format(c=c)}))" for c in (a, b))
    return f"""tx AS (SELECT DISTINCT {a} AS ta, {b} AS tb, {x} AS x, {y} AS y FROM {src}),
ts AS (SELECT ta, tb, len(x) > 0 AND len(y) > 0 AS ok, coalesce(array_to_string(list_filter(x, lambda z: list_contains(y, z)), ' '), '') AS bo, coalesce(array_to_string(list_filter(x, lambda z: NOT list_contains(y, z)), ' '), '') AS oa, coalesce(array_to_string(list_filter(y, lambda z: NOT list_contains(x, z)), ' '), '') AS ob FROM tx),
tu AS (SELECT *, CASE WHEN bo <> '' THEN bo || ' ' || oa ELSE oa END AS sa, CASE WHEN bo <> '' THEN bo || ' ' || ob ELSE ob END AS sb FROM ts),
tp AS (SELECT sa AS a, sb AS b FROM tu UNION SELECT bo, sa FROM tu UNION SELECT bo, sb FROM tu)"""


_SET_SCORE = """tr AS (SELECT ta, tb, CASE WHEN NOT ok THEN 0 WHEN bo <> '' AND (oa = '' OR ob = '') THEN 100 WHEN bo = '' THEN k1.ratio ELSE greatest(k1.ratio, k2.ratio, k3.ratio) END AS tset
  FROM tu JOIN kl k1 ON k1.a = sa AND k1.b = sb JOIN kl k2 ON k2.a = bo AND k2.b = sa JOIN kl k3 ON k3.a = bo AND k3.b = sb)"""
_PAIRS = """ab AS (SELECT x.p_partkey AS id, x.p_name AS a, CASE y.p_partkey % 4 WHEN 0 THEN lower(y.p_type) || ' ' || y.p_name WHEN 1 THEN replace(y.p_name, 'a', '') || ' co' WHEN 2 THEN regexp_replace(y.p_name, '^(\\S+) (\\S+)$', '\\2 \\1') ELSE y.p_name END AS b
  FROM part x JOIN part y ON y.p_partkey = (x.p_partkey * 7 + 3) % (SELECT max(p_partkey) FROM part))"""


def _pairs(spark, d) -> DataFrame:
    """Each part's name with a variant of another part's."""
    part = V.table(spark, d, "part")
    most = part.agg(F.max("p_partkey").alias("most"))
    b = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(lower(p_type), ' ', p_name) WHEN 1 THEN concat(replace(p_name, 'a', ''), ' co') WHEN 2 THEN regexp_replace(p_name, '^(\\\\S+) (\\\\S+)$', '$2 $1') ELSE p_name END")
    x = part.crossJoin(F.broadcast(most)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.expr("(p_partkey * 7 + 3) % most").alias("o"))
    return x.join(part.select(F.col("p_partkey").alias("o"), b.alias("b")), "o").select("id", "a", "b")


_WINDOWS = """sl AS (SELECT DISTINCT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM ab),
wi AS (SELECT a, b, s, substr(l, greatest(0, j) + 1, least(length(l), j + length(s)) - greatest(0, j)) AS w FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS j FROM sl)
  UNION SELECT a, b, l, substr(s, greatest(0, j) + 1, least(length(s), j + length(l)) - greatest(0, j)) FROM (SELECT *, unnest(range(1 - length(l), length(s))) AS j FROM sl WHERE length(s) = length(l)))"""


@query(f"""WITH RECURSIVE {_PAIRS}, {_set_parts('ab', 'a', 'b')}, {_WINDOWS},
kp AS (SELECT a, b FROM ab UNION SELECT {_sorted('a')}, {_sorted('b')} FROM ab UNION SELECT a, b FROM tp UNION SELECT replace(a, ' ', ''), replace(b, ' ', '') FROM ab UNION SELECT s, w FROM wi), {_LCS}, {_SET_SCORE},
pr AS (SELECT wi.a, wi.b, max(ratio) AS partial FROM wi JOIN kl ON kl.a = wi.s AND kl.b = wi.w GROUP BY wi.a, wi.b)
SELECT id, round(k1.ratio, 6) AS ratio, round(k2.ratio, 6) AS token_sort, round(tset, 6) AS token_set, round(k3.ratio, 6) AS squeezed, round(partial, 6) AS partial FROM ab JOIN kl k1 ON k1.a = ab.a AND k1.b = ab.b JOIN kl k2 ON k2.a = {_sorted('ab.a')} AND k2.b = {_sorted('ab.b')}
JOIN tr ON ta = ab.a AND tb = ab.b JOIN kl k3 ON k3.a = replace(ab.a, ' ', '') AND k3.b = replace(ab.b, ' ', '') JOIN pr ON pr.a = ab.a AND pr.b = ab.b""")
def kernel_scores(spark, d):
    """Ratio, token sort, token set and partial ratio, in one Arrow pass."""
    a, b = F.col("a"), F.col("b")
    squeezed = [F.replace(c, F.lit(" "), F.lit("")) for c in (a, b)]
    found = strsim.kernels({"ratio": ("ratio", a, b), "token_sort": ("token_sort", a, b), "token_set": ("token_set", a, b), "squeezed": ("ratio", *squeezed), "partial": ("partial", a, b)})
    return rounded(_pairs(spark, d).select("id", found.alias("k")).select("id", "k.*"), "ratio", "token_sort", "token_set", "squeezed", "partial")


@query(f"""WITH RECURSIVE {_PAIRS}, tk AS (SELECT id, list_filter(string_split(a, ' '), lambda z: z <> '') AS x, list_filter(string_split(b, ' '), lambda z: z <> '') AS y FROM ab),
kp AS (SELECT DISTINCT a, unnest(y) AS b FROM (SELECT unnest(x) AS a, y FROM tk)), {_LCS},
ma AS (SELECT a, b, a = b OR starts_with(a, b) OR starts_with(b, a) OR (length(a) >= 4 AND length(b) >= 4 AND ratio >= 80) AS hit FROM kl),
nb AS (SELECT id, count(*) AS n, count(*) FILTER (h) AS hits FROM (SELECT id, j, bool_or(hit) AS h FROM (SELECT id, x, unnest(y) AS b, unnest(range(len(y))) AS j FROM tk) t, ma WHERE ma.b = t.b AND list_contains(x, ma.a) GROUP BY id, j) GROUP BY id),
na AS (SELECT id, count(*) AS n, count(*) FILTER (h) AS hits FROM (SELECT id, j, bool_or(hit) AS h FROM (SELECT id, y, unnest(x) AS a, unnest(range(len(x))) AS j FROM tk) t, ma WHERE ma.a = t.a AND list_contains(y, ma.b) GROUP BY id, j) GROUP BY id)
SELECT id, round(nb.hits / nb.n::DOUBLE, 6) AS n_abbr_b, round(na.hits / na.n::DOUBLE, 6) AS n_abbr_a, (na.hits = na.n)::INT::DOUBLE AS n_a_in_b, (nb.n - nb.hits)::DOUBLE AS n_extra_b FROM nb JOIN na USING (id)""")
def abbreviation_scores(spark, d):
    """Which words of either side stand, whole or shortened, on the other."""
    found = strsim.kernels({"abbr": ("abbreviations", F.col("a"), F.col("b"))})
    return rounded(_pairs(spark, d).select("id", found.alias("k")).select("id", "k.*"), "n_abbr_b", "n_abbr_a")


_SUP = f"{V.PAIRS}, {_POOL}, t AS (SELECT pairs.*, name_key AS name, addr_norm AS addr, row_number() OVER (PARTITION BY q ORDER BY prob2 DESC, p) AS rk FROM pairs JOIN pool ON id = p QUALIFY rk <= 6)"


@query(f"""WITH RECURSIVE {_SUP}, sp AS (SELECT i.q, i.p, i.src AS s, j.src AS js, j.prob2 AS jp, j.rk AS jr, i.name AS n1, j.name AS n2, i.addr AS a1, j.addr AS a2 FROM t i JOIN t j ON i.q = j.q AND i.p <> j.p),
su AS (SELECT DISTINCT n1 AS u, n2 AS v FROM sp UNION SELECT a1, a2 FROM sp), {_set_parts('su', 'u', 'v')}, kp AS (SELECT a, b FROM tp), {_LCS}, {_SET_SCORE},
b AS (SELECT sp.*, round(x.tset / 100, 9) AS n, round(y.tset / 100, 9) AS a FROM sp JOIN tr x ON x.ta = n1 AND x.tb = n2 JOIN tr y ON y.ta = a1 AND y.tb = a2),
g AS (SELECT q, p, max(n) AS nm, max(a) AS am, arg_max(jp, n * 1000000 - jr) AS pb, count(*) FILTER (n >= 0.8 OR a >= 0.9) AS ns, sum(jp * greatest(n, a)) AS w, max(CASE WHEN s <> js THEN n ELSE 0 END) AS o FROM b GROUP BY q, p)
SELECT q, p, round(nm, 6) AS sup_name_max, round(am, 6) AS sup_addr_max, round(pb, 6) AS sup_prob_of_best, ns AS sup_n_similar, round(w, 6) AS sup_weighted, round(o, 6) AS sup_other_src_name_max FROM pairs LEFT JOIN g USING (q, p)""")
def support_by_words(spark, d):
    """E35 with the token set ratio of names and addresses."""
    x = V.pairs(spark, d).select("q", "p", "src", "prob2").join(_pool(spark, d).select(F.col("id").alias("p"), F.col("name_key").alias("name"), F.col("addr_norm").alias("addr")), "p")
    s = rec.support(x, lambda a, b: F.round(strsim.token_set_ratio(a, b) / 100, 9))
    return rounded(s, "sup_name_max", "sup_addr_max", "sup_prob_of_best", "sup_weighted", "sup_other_src_name_max").drop("src", "prob2", "name", "addr")


_FLAGS = f"{NORMALIZED}, pq AS (SELECT x.p_partkey AS q, y.p_partkey AS p, 2 + y.p_partkey % 2 AS src FROM part x JOIN part y ON y.p_partkey = (x.p_partkey * 7 + 3) % (SELECT max(p_partkey) FROM part))"


@query(f"""WITH {_FLAGS}, f AS (SELECT q, p, src, a.legal AS la, b.legal AS lb, a.addr_empty AS ea, b.addr_empty AS eb, b.is_domain, b.non_ascii, b.has_alias, list_filter(string_split(a.nums, ' '), lambda x: length(x) >= 5) AS l5, list_filter(string_split(b.nums, ' '), lambda x: length(x) >= 5) AS r5 FROM pq JOIN norm a ON a.entity_id = q::VARCHAR JOIN norm b ON b.entity_id = p::VARCHAR)
SELECT q, p, (la = lb)::INT::DOUBLE AS legal_eq, round({Q._JAC.format(a=Q.toks('la'), b=Q.toks('lb'))}, 6) AS legal_jacc, CASE WHEN len(l5) > 0 AND len(r5) > 0 THEN (len(list_intersect(l5, r5)) > 0)::INT::DOUBLE END AS post_eq,
ea::DOUBLE AS a_empty_a, eb::DOUBLE AS a_empty_b, is_domain::DOUBLE AS b_domain, non_ascii::DOUBLE AS b_non_ascii, src::DOUBLE AS b_src, (lb = '')::INT::DOUBLE AS b_legal_empty, has_alias::DOUBLE AS b_alias FROM f""")
def pair_flags(spark, d):
    """Legal forms, post codes and side flags of the feature matrix, over normalised records."""
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("q"))
    pairs = part.crossJoin(F.broadcast(part.agg(F.max("q").alias("most")))).select("q", F.expr("(q * 7 + 3) % most").alias("p"))
    n = _normal(spark, d).withColumn("id", F.col("entity_id").cast("long")).withColumn("src", F.col("id") % 2 + 2)
    x = rec.pair_features(pairs, n, n)
    return rounded(x.select("q", "p", "legal_eq", "legal_jacc", "post_eq", "a_empty_a", "a_empty_b", "b_domain", "b_non_ascii", "b_src", "b_legal_empty", "b_alias"), "legal_jacc")


def _count(side: str, key: str) -> str:
    return f"(SELECT country, {key} AS k, count(*) AS c FROM records WHERE side = '{side}' GROUP BY ALL)"


def _counted(own: str) -> str:
    cols, joins = [], []
    for name, side in (("s1", "a"), ("pool", "b")):
        for kind, key in (("addr", "addr_norm"), ("name", "name_key")):
            at = f"{kind[0]}{side}"
            joins.append(f"LEFT JOIN {_count(side, key)} {at} ON {at}.country = r.country AND {at}.k = r.{key}")
            value = f"coalesce({at}.c, 0)"
            cols.append(f"{f'''CASE WHEN r.addr_norm <> '' THEN {value} END''' if kind == 'addr' else value} AS {own}_{kind}_{name}_cnt")
    return f"SELECT id, {', '.join(cols)} FROM records r {' '.join(joins)} WHERE side = '{own}'"


@query(f"WITH {V.RECORDS}, a AS ({_counted('a')}), b AS ({_counted('b')}) SELECT 'a' AS side, id, a_addr_s1_cnt AS addr_s1, a_name_s1_cnt AS name_s1, a_addr_pool_cnt AS addr_pool, a_name_pool_cnt AS name_pool FROM a UNION ALL SELECT 'b', * FROM b")
def record_counts(spark, d):
    """All eight counts of records that share an address or a name, kept for the next use."""
    n = V.records(spark, d)
    a, b = rec.held_record_features(n.where("side = 'a'"), n.where("side = 'b'"))
    side = lambda x, s: x.select(F.lit(s).alias("side"), "id", *[F.col(f"{s}_{k}_cnt").alias(k) for k in ("addr_s1", "name_s1", "addr_pool", "name_pool")])
    return side(a, "a").unionByName(side(b, "b"))


# ------------------------------------------------------------------ the validator

_LINE = """ln AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 1 THEN 'S1-' || p_partkey ELSE 'S1-' || p_partkey || chr(9) || 'S2-' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN ',S2-' || p_partkey WHEN 1 THEN ',S3-' || p_partkey WHEN 2 THEN ',S1-' || p_partkey WHEN 3 THEN ',X-' || p_partkey ELSE '' END END AS line FROM part WHERE p_partkey % 40 <> 7
  UNION ALL SELECT p_partkey, 'S1-' || p_partkey || chr(9) FROM part WHERE p_partkey % 45 = 5 UNION ALL SELECT p_partkey, 'S1-x' || p_partkey || chr(9) || 'S2-' || p_partkey FROM part WHERE p_partkey % 60 = 9),
fs AS (SELECT *, string_split(line, chr(9)) AS f FROM ln), rw AS (SELECT f[1] AS q, list_filter(string_split(f[2], ','), lambda x: x <> '') AS ids FROM fs WHERE len(f) = 2), ea AS (SELECT q, unnest(ids) AS p FROM rw), rq AS (SELECT 'S1-' || p_partkey AS q FROM part),
vi AS (SELECT 'malformed row' AS rule, line AS x FROM fs WHERE len(f) <> 2 UNION ALL SELECT 'duplicate row', q FROM rw GROUP BY q HAVING count(*) > 1 UNION ALL SELECT 'duplicate id', q || ':' || p FROM ea GROUP BY q, p HAVING count(*) > 1 UNION ALL SELECT 'self match', q FROM ea WHERE q = p
  UNION ALL SELECT 'bad prefix', p FROM ea WHERE NOT regexp_matches(p, '^S[23]-') AND p <> q UNION ALL SELECT 'missing id', q FROM rq WHERE q NOT IN (SELECT q FROM rw) UNION ALL SELECT 'extra id', q FROM rw WHERE q NOT IN (SELECT q FROM rq)
  UNION ALL SELECT 'unknown id', p FROM ea WHERE p NOT IN (SELECT 'S2-' || p_partkey FROM part WHERE p_partkey % 9 <> 0) UNION ALL SELECT 'warning: not a candidate', q || ':' || p FROM ea WHERE (q, p) NOT IN (SELECT ('S1-' || p_partkey, 'S2-' || p_partkey) FROM part WHERE p_partkey % 8 <> 0))"""


@query(f"WITH {_LINE} SELECT rule, count(*) AS n, array_to_string((list_sort(list(x)))[1:5], '|') AS examples FROM vi GROUP BY rule")
def list_violations(spark, d):
    """Every rule of the match-list validator, over lines that break each of them."""
    part = V.table(spark, d, "part")
    one = F.expr("CASE WHEN p_partkey % 50 = 1 THEN concat('S1-', p_partkey) ELSE concat('S1-', p_partkey, '\\t', 'S2-', p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat(',S2-', p_partkey) WHEN 1 THEN concat(',S3-', p_partkey) WHEN 2 THEN concat(',S1-', p_partkey) WHEN 3 THEN concat(',X-', p_partkey) ELSE '' END) END")
    body = part.where("p_partkey % 40 <> 7").select(one.alias("line")).unionByName(part.where("p_partkey % 45 = 5").select(F.expr("concat('S1-', p_partkey, '\\t')").alias("line"))).unionByName(part.where("p_partkey % 60 = 9").select(F.expr("concat('S1-x', p_partkey, '\\t', 'S2-', p_partkey)").alias("line")))
    own = lambda n, where: part.where(where).select(F.concat(F.lit(n), "p_partkey"))
    both = part.where("p_partkey % 8 <> 0").select(F.concat(F.lit("S1-"), "p_partkey").alias("q"), F.concat(F.lit("S2-"), "p_partkey").alias("p"))
    found = lists.violations(body, own("S1-", "true").toDF("id"), own("S2-", "p_partkey % 9 <> 0").toDF("id"), both)
    return found.select("rule", "n", F.array_join("examples", "|").alias("examples"))
