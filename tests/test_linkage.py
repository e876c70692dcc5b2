"""Edge cases of the linkage operators on hand-written rows."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import strsim, text
from weft.operators import blocking, competition, decide, ensemble, metrics, models, records, sampling, synth, translit
from weft.plans import views
from weft.sources import lists
from weft.streaming import linkage

PAIR = "q long, p long, src long, prob double"


def frame(spark, rows, schema=PAIR):
    return spark.createDataFrame(rows, schema)


def pairs_of(df):
    return sorted((r.q, r.p) for r in df.collect())


def norm(spark, name, addr="", country="us"):
    df = spark.createDataFrame([("S1-1", name, addr, country)], lists.RECORD)
    return text.normalize(df).first()


@pytest.mark.parametrize(
    "raw,country,want",
    [
        ("Avixylo dba Gonzalez Landscaping", "us", {"name_norm": "gonzalez landscaping", "has_alias": 1}),
        ("coastaltungsten.com", "us", {"name_norm": "coastaltungsten", "is_domain": 1}),
        ("www.two-words.co.in", "India", {"name_norm": "two words", "is_domain": 1}),
        ("Acme (ID: 93967) Pvt. Ltd.", "india", {"name_norm": "acme pvt ltd", "name_core": "acme", "legal": "ltd pvt"}),
        ("M/s Raam Bros", "india", {"name_norm": "raam brothers", "name_key": "ram brothers", "name_sq": "rambrothers"}),
        ("Pvt Ltd", "us", {"name_core": "pvt ltd", "legal": "ltd pvt"}),
        ("S.A.S. Ets Générale", "France", {"name_norm": "sas etablissements generale", "legal": "sas", "non_ascii": 1}),
        ("St0re4ll & Co", "us", {"name_norm": "storeall and co", "name_core": "storeall"}),
        ("", "us", {"name_norm": "", "legal": "", "has_alias": 0}),
        (None, None, {"name_norm": ""}),
        ("a​b", "us", {"name_norm": "ab", "non_ascii": 0}),
    ],
)
def test_names(spark, raw, country, want):
    got = norm(spark, raw, "", country).asDict()
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize(
    "raw,country,addr,nums",
    [
        ("Apt 00412, Main St., NY", "US", "412 main street new york", "412"),
        ("000 First Ave", "us", "0 1st avenue", "0 1"),
        ("12 St Nazaire, Nord, France", "France", "12 saint nazaire", "12"),
        ("5 n/a Road, MH", "india", "5 road maharashtra", "5"),
        ("", "us", "", ""),
    ],
)
def test_addresses(spark, raw, country, addr, nums):
    r = norm(spark, "x", raw, country)
    assert (r.addr_norm, r.nums, r.addr_empty) == (addr, nums, int(addr == ""))


def test_romanise():
    assert text.romanise("राम") == "raam" and text.romanise("Straße Œuvre №5") == "strasse oeuvre no5"
    assert text.romanise("दिल्ली") == "dillii" and text.romanise(None) is None


def test_transliterate(spark):
    df = spark.createDataFrame([(1, "राम, Stores"), (2, "x"), (3, "")], "id int, t string")
    table = spark.createDataFrame([("राम", "ram")], "src string, dst string")
    assert {r.id: r.t for r in text.transliterate(df, "t", table).collect()} == {1: "ram, Stores", 2: "x", 3: ""}


def test_learn(spark):
    rows = [("ram stores", "1 a, delhi", f"राम {k}", "दिल्ली") for k in range(3)] + [("other", "", "अन्य", "")]
    got = {r.src: r.dst for r in translit.learn(spark.createDataFrame(rows, "a_name string, a_addr string, b_name string, b_addr string")).collect()}
    assert got == {"राम": "ram", "दिल्ली": "delhi"}


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarity():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert strsim.lcs(a, b) == plain_lcs(a, b)
        assert strsim.ratio_of(a, b) == strsim.ratio_of(b, a) and 0 <= strsim.ratio_of(a, b) <= 100
        assert strsim.partial_of(a, b) == strsim.partial_of(b, a)
        assert strsim.token_set_of(a, b) == strsim.token_set_of(b, a)
    assert strsim.ratio_of("", "") == 100 and strsim.token_set_of("", "a") == 0 and strsim.token_set_of("a b", "a b c") == 100
    assert strsim.partial_of("abc", "xxabcx") == 100 and strsim.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert strsim.abbreviations_of("smith group", "smi grp x") == (2 / 3, 0.5, 0.0, 1.0) or strsim.abbreviations_of("smith group", "smi grp x")[0] >= 1 / 3
    assert strsim.abbreviations_of("", "a") == (None,) * 4


def test_numbers(spark):
    def of(a, b):
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        return df.select(*[c.alias(n) for n, c in strsim.number_features(F.col("a"), F.col("b")).items()]).first()

    assert set(of([], ["1"])) == {None}
    r = of(["2454", "90210"], ["245", "90210"])
    assert (r.num_first_eq, r.num_fix, r.post_eq, r.num_common) == (0, 1, 1, 1) and r.num_house_diff == 0
    assert of(["1014"], ["014"]).num_fix == 1 and of(["7"], ["7"]).post_eq is None and of(["12345678"], ["1"]).num_house_diff is None


def test_second_of_one_is_zero_and_ranks_share(spark):
    r = {(x.q, x.p): x for x in competition.prob_features(frame(spark, [(1, 1, 2, 0.5), (1, 2, 2, 0.5), (2, 1, 3, 0.9)])).collect()}
    assert r[2, 1].q_second == 0 and r[1, 1].q_rank == r[1, 2].q_rank == 1 and r[1, 2].p_second == 0


def test_assignment_gives_one_owner(spark):
    got = decide.assign_best(frame(spark, [(2, 1, 2, 0.5), (1, 1, 2, 0.5), (3, 1, 2, 0.4), (3, 2, 2, 0.1)]))
    assert pairs_of(got) == [(1, 1), (3, 2)]
    assert decide.assign_best(frame(spark, [])).count() == 0


def test_expected_f_is_the_best_prefix(spark):
    rng = random.Random(2)
    rows = [(q, 10 * q + k, 2, rng.randrange(1, 101) / 101) for q in range(30) for k in range(rng.randrange(1, 6))] + [(99, 999, 2, 1.0)]
    got = {}
    for q, p in pairs_of(decide.expected_f(frame(spark, rows))):
        got.setdefault(q, set()).add(p)
    for q in {r[0] for r in rows}:
        own = sorted(((r[3], r[1]) for r in rows if r[0] == q and r[3] >= 0.05), key=lambda x: (-x[0], x[1]))
        total, best, none = sum(x for x, _ in own), (0, 0), 1.0
        for x, _ in own:
            none *= 1 - min(x, 0.999999)
        for j in range(1, len(own) + 1):
            tp = sum(x for x, _ in own[:j])
            f = round(1.25 * tp / (1.25 * tp + 0.25 * (total - tp) + j - tp), 9)
            best = max(best, (f, -j))
        assert got.get(q, set()) == ({p for _, p in own[: -best[1]]} if best[0] > round(none, 9) else set())


def test_f05_cases(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 2), (0, 2, 0), (0, 1, 1), (1, 1, 1), (1, 2, 1)], "tp long, n long, t long")
    got = [r.f for r in df.select(metrics.f05(F.col("tp"), F.col("n"), F.col("t")).alias("f")).collect()]
    assert got == [1, 0, 0, 0, 1, pytest.approx(1.25 * 0.5 / (0.125 + 1))]


def test_macro_counts_entities_without_rows(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    r = metrics.evaluate(frame(spark, [(1, 1, 2, 0.9)]), frame(spark, [(1, 1), (2, 5)], "q long, p long"), ids).first()
    assert r.macro_f05 == pytest.approx(2 / 3) and r.n == 3 and r.micro_recall == 0.5


def test_auc_against_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(9) / 7 - 0.1, rng.randrange(2)) for _ in range(60)]
    want = sum((a > b) + (a == b) / 2 for (a, x), (b, y) in ((u, v) for u, v in combinations(rows, 2)) for a, b in ([(a, b)] if x > y else [(b, a)] if y > x else []))
    n = sum(y for _, y in rows)
    r = metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert r.auc == pytest.approx(want / n / (60 - n))


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.10001,), (0.3,), (0.4,)], "x double")
    assert [r.b for r in df.select(metrics.right_closed(F.col("x"), [0.0, 0.1, 0.3]).alias("b")).collect()] == [None, 0, 1, 1, None]


def test_vote_tie_goes_with_the_reference(spark):
    r = [frame(spark, rows, "q long, p long") for rows in ([(1, 1), (1, 2)], [(1, 1), (2, 3)], [(2, 3)], [(1, 9)])]
    cands = frame(spark, [(1, 1), (2, 3), (1, 2)], "q long, p long")
    assert pairs_of(ensemble.vote(r, 0, 3, cands)) == [(1, 1)]
    assert pairs_of(ensemble.vote(r, 1, 3, cands)) == [(1, 1), (2, 3)]


def test_rescue_keeps_base(spark):
    best = frame(spark, [(1, 1, 2, 0.9), (1, 2, 2, 0.6), (2, 3, 2, 0.6), (3, 4, 2, 0.1)])
    assert pairs_of(decide.rescue_empty(best, decide.threshold(best, 0.8), 0.5)) == [(1, 1), (2, 3)]


def test_fold_is_the_unsigned_shift(spark):
    ids = [0, 1, 2, 127, 128, 2**31 - 1]
    got = [r.f for r in spark.createDataFrame([(i,) for i in ids], "q long").select(sampling.fold(F.col("q")).alias("f")).collect()]
    assert got == [(i * 2654435761 >> 7) % 2 for i in ids]


def test_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r.m for r in df.select(ensemble.mean_of_available(["a", "b", "c"]).alias("m")).collect()] == [2.0, None]


def test_lists_round_trip_and_validate(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "q string")
    chosen = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "q string, p string")
    out = lists.to_lists(chosen, ids)
    assert sorted(map(tuple, out.collect())) == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    path = str(tmp_path / "ok")
    lists.write_tsv(out.coalesce(1), path)
    assert pairs_of(lists.read_lists(spark, path)) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    need = ids.withColumnRenamed("q", "id")
    assert lists.validate(spark, path + "/part-*.csv", need).count() == 0
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id,matched\nS1-1\tS2-1,S2-1,S1-1\nS1-1\tX9\nnotab\nS1-7\tS2-8\n")
    known = spark.createDataFrame([("S2-1",), ("S1-1",), ("X9",)], "id string")
    cands = spark.createDataFrame([("S1-1", "S2-1")], "q string, p string")
    got = {r.rule: r.n for r in lists.validate(spark, str(bad), need, known=known, candidates=cands).collect()}
    assert got == {"header": 1, "malformed row": 1, "duplicate row": 1, "duplicate id": 1, "self match": 1, "bad prefix": 1, "missing id": 1, "extra id": 1, "unknown id": 1, "warning: not a candidate": 3}
    empty = tmp_path / "empty.tsv"
    empty.write_text("")
    assert {r.rule for r in lists.validate(spark, str(empty), need).collect()} == {"header", "missing id"}


def test_tsv_keeps_text(spark, tmp_path):
    f = tmp_path / "r.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"A\tNA\t\nS2-2\tnull\t\tUS\n', encoding="utf-8")
    a, pool = lists.read_records(spark, str(f), str(f))
    assert [tuple(r) for r in a.orderBy("entity_id").collect()] == [("S2-1", '"A', "NA", ""), ("S2-2", "null", "", "US")]
    assert {r.src for r in pool.collect()} == {2}


def test_boosting_and_scorers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, k % 2, k % 7 == 0, x := rng.random(), None if k % 5 else 1.0, float(x > 0.5)) for k in range(200)]
    df = spark.createDataFrame(rows, "q long, fold int, val boolean, x double, z double, y double")
    ms, scored = models.two_fold(df, lambda: models.Boosted(["x", "z"], 3, 2))
    assert scored.count() == 200 and scored.where((F.col("prob") > 0.5) == (F.col("y") == 1)).count() > 190
    assert ms[0].importances()["x"] > 0.9
    ms[0].save(str(tmp_path / "m"))
    again = models.Boosted(["x", "z"]).load(str(tmp_path / "m"))
    assert again.score(df).orderBy("q").first().prob == ms[0].score(df).orderBy("q").first().prob
    t = spark.createDataFrame([("ab", "ab"), ("ab", "cd"), ("", "")], "a string, b string")
    s = models.TextScorer(lambda: lambda a, b: [strsim.ratio_of(x, y) / 100 for x, y in zip(a, b)]).score(t, "ce")
    assert sorted(r.ce for r in s.collect()) == [0, 1, 1]


def test_synthetic_world(spark):
    n = spark.createDataFrame([(k, f"name {k} service", f"{k} main street", "us") for k in range(60)], "id long, name string, addr string, country string")
    own = n.where("id < 40").drop("country")
    fake = n.where("id >= 40").select(F.col("id").alias("p"), "name", "addr", F.expr("int(2 + id % 2)").alias("src"))
    counts = own.select(F.col("id").alias("q"), F.expr("id % 3").alias("n2"), F.expr("id % 2").alias("n3"))
    a, pool, truth = synth.world(own, fake, counts)
    assert truth.join(pool, "p", "left_anti").count() == 0 and truth.join(a, "q", "left_anti").count() == 0
    assert pool.count() == sum(k % 3 + k % 2 for k in range(40)) + 20
    assert sorted(pool.collect()) == sorted(synth.world(own.repartition(5), fake, counts)[1].collect())
    for size in (1000, 7):
        g = synth.groups(n, bucket=size).collect()
        assert {r.gid for r in g} == set(range(60)) and sum(r.y for r in g) == 60


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(7, "a")], "p long, name string").write.parquet(src)
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "q long, name string")
    arrivals = spark.readStream.schema("p long, name string").parquet(src)
    linkage.link_stream(arrivals, ids, lambda e, b: e.join(b, "name").select("q", "p"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert pairs_of(spark.read.parquet(str(tmp_path / "out"))) == [(1, 7)]


def test_transliterate_keeps_rows_apart(spark):
    df = spark.createDataFrame([(1, "राम a"), (1, "b"), (1, "राम a"), (2, None)], "id int, t string")
    table = spark.createDataFrame([("राम", "ram"), ("राम", "raam"), ("a", "x")], "src string, dst string")
    assert sorted((r.id, r.t) for r in text.transliterate(df, "t", table).collect() if r.t) == [(1, "b"), (1, "raam x"), (1, "raam x")]
    part = spark.createDataFrame([("a राम, a",)], "t string")
    assert text.transliterate(part, "t", table, True).first().t == "x raam, a"


def test_drop_after_expansion(spark):
    assert norm(spark, "x", "12 Ste Anne, Lille", "France").addr_norm == "12 sainte anne lille"
    assert norm(spark, "x", "12 Main Ste 4", "US").addr_norm == "12 main 4" and norm(spark, "x", "3 ciy flor", "US").addr_norm == "3"


def test_kernels_in_batches():
    rng = random.Random(3)
    a, b = ([("".join(rng.choice("abcdé ") for _ in range(rng.choice((0, 1, 5, 20, 63, 64, 65, 130))))) for _ in range(400)] for _ in range(2))
    assert strsim.lcs_many(a, b).tolist() == [strsim.lcs(x, y) for x, y in zip(a, b)]
    assert strsim.ratio_many(a, b).tolist() == pytest.approx([strsim.ratio_of(x, y) for x, y in zip(a, b)])
    assert strsim.token_set_many(a, b).tolist() == pytest.approx([strsim.token_set_of(x, y) for x, y in zip(a, b)])
    a, b = a[:60], b[:60]
    assert strsim.partial_many(a, b).tolist() == pytest.approx([strsim.partial_of(x, y) for x, y in zip(a, b)])
    assert strsim.lcs_many([], []).tolist() == []


def test_listwise_loss_of_great_logits(spark):
    df = spark.createDataFrame([(1, 900.0, 1), (1, 890.0, 0), (2, -900.0, 1), (2, 0.0, 0)], "gid int, s double, y int")
    got = {r.gid: r.loss for r in models.info_nce(df).collect()}
    assert got[1] == pytest.approx(math.log1p(math.exp(-10))) and got[2] == pytest.approx(900.0)


def test_prepare_dictionary_and_report(spark, tmp_path):
    folder = tmp_path / "data" / "train"
    folder.mkdir(parents=True)
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (folder / "train_source1.tsv").write_text(head + "S1-1\tराम Ltd\t1 Main St\tIndia\nS1-2\tCafé SARL\t2 Ste Anne\tFrance\n")
    (folder / "train_source2.tsv").write_text(head + "S2-1\tRam\t1 Main St\tIndia\n")
    (folder / "train_source3.tsv").write_text(head + "S3-1\tCafe\t\tFrance\n")
    lists.save_dictionary(spark.createDataFrame([("राम", "ram")], "src string, dst string"), f"{tmp_path}/d")
    (tmp_path / "one.json").write_text('{"राम": "ram", "x": "y"}')
    known = lists.load_dictionary(spark, f"{tmp_path}/d")
    assert [tuple(r) for r in known.collect()] == [("राम", "ram")] and lists.load_dictionary(spark, f"{tmp_path}/one.json").count() == 2
    lists.prepare(spark, f"{tmp_path}/data", "train", f"{tmp_path}/out", known)
    first, pool = lists.load_prepared(spark, f"{tmp_path}/out", "train")
    assert {r.entity_id: (r.name_key, r.addr_norm, r.country) for r in first.collect()} == {"S1-1": ("ram", "1 main street", "india"), "S1-2": ("cafe", "2 sainte anne", "france")}
    assert {r.entity_id: r.src for r in pool.collect()} == {"S2-1": 2, "S3-1": 3}
    new = spark.createDataFrame([("S2-9", "india")], "entity_id string, country string")
    lists.replace_countries(spark, pool.where("country = 'france'").select("entity_id", "country").unionByName(pool.where("country = 'india'").select("entity_id", "country")), f"{tmp_path}/cands")
    lists.replace_countries(spark, new, f"{tmp_path}/cands")
    assert sorted(r.entity_id for r in spark.read.parquet(f"{tmp_path}/cands").collect()) == ["S2-9", "S3-1"]
    lists.write_report(spark, {"best": 0.5, "rule": ["thr", 1]}, f"{tmp_path}/report")
    assert lists.read_report(spark, f"{tmp_path}/report") == {"best": 0.5, "rule": ["thr", 1]}
    assert lists.raw_paths("/x/", "test")["source3"] == "/x/test/test_source3.tsv"


def test_feature_matrix(spark, tmp_path):
    raw = [(k, f"Blue Ring {k} Ltd", f"{k} Main Rd", "US", 2 + k % 2) for k in range(6)]
    n = text.normalize(spark.createDataFrame(raw, "entity_id long, business_name string, business_address string, country string, src int")).withColumnRenamed("entity_id", "id")
    cands = spark.createDataFrame([(0, 1, 0.5, 0.2, 0.3), (0, 3, 0.4, 0.1, 0.2), (2, 3, 0.9, 0.8, 0.85)], "q long, p long, name_cos double, addr_cos double, comb double")
    a, b = n.where("id % 2 = 0"), n.where("id % 2 = 1")
    x = records.feature_matrix(cands, a, b)
    assert x.count() == 3 and {"q_n", "n_ratio", "b_src", "legal_eq", "a_addr_pool_cnt", "b_oov_frac", "n_abbr_b", "p_second_comb"} <= set(x.columns)
    assert records.held_record_features(a, b)[0] is records.held_record_features(a, b)[0]
    staged = records.stage_features(x, f"{tmp_path}/x")
    assert staged.columns == x.columns and staged.count() == 3


def test_scores_by_saved_models_and_seeds(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.random(), k % 2, k % 10 == 0) for k in range(200)]
    df = spark.createDataFrame([(k, x, float(x + rng.random() * 0.2 > 0.6), f, v) for k, x, f, v in rows], "q long, x double, y double, fold int, val boolean")
    fitted, scored = models.many_seeds(df, lambda s: models.Boosted(["x"], 2, 2, s), [1, 2])
    for k, pair in enumerate(fitted):
        for f, m in enumerate(pair):
            m.save(f"{tmp_path}/m{k}{f}")
    loaded = [[models.Boosted(["x"]).load(f"{tmp_path}/m{k}{f}") for f in (0, 1)] for k in (0, 1)]
    again = {r.q: r.prob for r in models.rescore(loaded, df).collect()}
    assert {r.q: r.prob for r in scored.collect()} == pytest.approx(again) and len(again) == 200


def test_judge(spark):
    df = spark.createDataFrame([("A", "B", {"yes": -0.5, " Yes": -0.1, "no": -3.0}), ("A", None, {"x": -1.0})], "a string, b string, lp map<string,double>")
    got = df.select(models.judge_prompt("a", "b").alias("t"), models.best_answer("lp", models.YES).alias("yes"), models.best_answer("lp", models.NO).alias("no")).collect()
    assert got[0].t == "Record A: A\nRecord B: B\nSame business?" and (got[0].yes, got[0].no, got[1].yes) == (-0.1, -3.0, None)


def test_auc_of_scores_beyond_one(spark):
    df = spark.createDataFrame([(float(s), y) for s, y in ((-5, 0), (10, 0), (20, 1), (300, 1), (300, 0))], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(4.5 / 6)


def test_worlds(spark):
    own = spark.createDataFrame([(k, f"Firm {k} SARL", f"{k} rue Haute, Lille, Nord") for k in range(40)], "id long, name string, addr string")
    counts = synth.copy_counts(own.select(F.col("id").alias("q")), spark.createDataFrame([(k, k % 2, 1) for k in range(10)], "q long, n2 long, n3 long"), 3)
    assert counts.count() == 40 and {(r.n2, r.n3) for r in counts.collect()} == {(0, 1), (1, 1)}
    pool = spark.createDataFrame([(100 + k, "Decoy", "1 x", 2 + k % 2) for k in range(30)], "p long, name string, addr string, src int")
    fake = synth.unowned(pool, spark.createDataFrame([(100, 0.9)], "p long, prob double"), own, 0.02, 0.4)
    entities, records_, truth = synth.world(own, fake, counts)
    assert 100 not in {r.p for r in fake.collect()} and {r.src for r in records_.collect()} == {2, 3} and truth.count() > 20 and entities.count() < 40
    noisy = synth.add_french_noise(own.withColumn("other", F.lit("Autre")))
    assert noisy.count() == 40 and sum(a.name != b.name for a, b in zip(own.orderBy("id").collect(), noisy.orderBy("id").collect())) > 10


def test_blocks_of_queries_and_pool(spark, monkeypatch):
    """Products of blocks, however they are cut, are those of the join by term."""
    words, rng = ["ab", "abc", "bcd", "cde", "de", "ef"], random.Random(3)
    rows = [(k, "xy"[k % 2], "ab"[k % 3 == 0], " ".join(rng.choices(words, k=3)), "" if k % 7 == 0 else words[k % 5]) for k in range(60)]
    r = spark.createDataFrame(rows, "id long, country string, side string, name_key string, addr_norm string")
    index = blocking.tfidf(r, blocking.char_grams(F.col("name_key")), 2, None)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "p")
    want = blocking.dots(index).where("sim > 0.2").withColumn("rk", F.row_number().over(w)).where("rk <= 4").drop("rk")
    want = sorted(map(tuple, want.select("country", "q", "p", "sim").collect()))
    for queries, pool in ((16384, 65536), (3, 4)):
        monkeypatch.setattr(blocking, "QUERIES", queries)
        monkeypatch.setattr(blocking, "POOL", pool)
        found = blocking.top_n(index, 4, 0.2)
        assert sorted(map(tuple, found.select("country", "q", "p", "sim").collect())) == want and want
    values = np.round(np.random.default_rng(1).random(640), 2)
    ids = np.random.default_rng(2).permutation(640)
    assert sorted(blocking.largest(values, 7, 0.1, ids)) == sorted(sorted(range(640), key=lambda k: (-values[k], ids[k]))[:7])


def test_labelled_pairs(spark, tmp_path, monkeypatch):
    """Look-alikes as in plain Python, by buckets too; the input is read three times, not once and twice for each key."""
    monkeypatch.setattr(synth, "BUCKET", 3)
    monkeypatch.setattr(synth, "add_noise", lambda text, *_: text)
    rows = [(k, [f"first {k % 4}", "x", None, ""][k % 9 % 4], ["1 main st", f"{k} main  st", None, ""][k % 5 % 4]) for k in range(60)] + [(7, "first b", "1 main st"), (7, "first a", "1 main st")]
    frame(spark, rows, "id long, name string, addr string").write.parquet(f"{tmp_path}/r")
    got = synth.labelled_pairs(spark.read.parquet(f"{tmp_path}/r"))
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3
    h = {r[0]: r[1] for r in spark.range(60).select("id", F.xxhash64("id")).collect()}
    text_of = lambda n, a: " | ".join(x for x in (n, a) if x is not None)
    want = [(text_of(n, a), text_of(n, a), 1) for _, n, a in rows]
    street = lambda a: re.sub(r"\s+", " ", re.sub(r"\d+", "", a)).strip(" ")
    for key in (lambda n, a: a, lambda n, a: a and street(a), lambda n, a: n and n.split(" ")[0]):
        sets = {}
        for i, n, a in rows:
            if key(n, a):
                sets.setdefault(key(n, a), []).append((i, text_of(n, a)))
        assert max(map(len, sets.values())) > 9
        for s in sets.values():
            buckets = {}
            for i, t in sorted(s):
                buckets.setdefault(h[i] % -(-len(s) // 3), []).append(t)
            want += [(a, b, 0) for x in buckets.values() for a, b in zip(x, x[1:]) if a != b]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_records_of_odd_texts(spark, tmp_path):
    """The first ten words are those of the whole text, cleaned."""
    texts = [None, "", " \n", "!" * 5000, "a", "À-É ß K İ Σ x", "one, two " * 3, ("é" * 5000 + " ! ") * 9, "  " + ("w.́ " * 12), "\U0001d5d4 b c d\re" * 4, "a b c d e f g h i j", "a b c d e f g h i j!", " ".join("abcdefghijk") + "…" * 90000, "\0x\0" * 11]
    frame(spark, [(k + 1, "en", "s", t) for k, t in enumerate(texts)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.name_key, r.addr_norm) for r in views.records(spark, str(tmp_path)).collect()}
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9à-öø-ÿß]+", " "), " "), lambda x: x != "").alias("w")
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", w).collect():
        assert got[r.doc_id] == ((None, "s") if r.w is None else (" ".join(r.w[:6]), "s " + " ".join(r.w[6:10])))
