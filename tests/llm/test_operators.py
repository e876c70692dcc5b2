"""Each operator against a brute-force version, on a small fixture with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import binary, chunks, covertree, dcover, decontam, extract, licenses, packing, queries, simhash, suffix, toxicity
from weft.llm.common import components

SCHEMA = "doc_id long, text string, lang string, id long, t string, h long, name string, n long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abdeinorst"), rng.integers(2, 8))) for _ in range(n))


def fixture_texts():
    rng = np.random.default_rng(5)
    base = [sentence(rng, int(n)) for n in rng.integers(5, 120, 30)]
    passage = sentence(rng, 70)
    texts = [None, "", " \n ", "one", "two words", "É ß Ça it's  x\t<|endoftext|>"] + base
    texts += [base[0], base[0], base[3] + " tail words", passage + ". " + base[5], base[6] + ".\n" + passage, base[7] + " " + passage + " " + base[8]]
    texts += ["idiot scum " * 30, sentence(rng, 6000), "Released under the MIT License. " + base[9], "日本語のテキスト" * 60]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = fixture_texts()
    rows = [(k, t, "en", -1, "clash", 5, "x", 9) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return fixture_texts()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(60)] + [(100, int(k)) for k in range(101, 140)] + [tuple(map(int, p)) for p in rng.integers(200, 300, (60, 2))]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(300, pairs)
    assert all(got.get(k, k) == want[k] for k in range(300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name,words,end", [("word_bpe_49k.json", True, 1), ("byte_bpe_50k.json", False, 0)])
def test_ids_are_the_librarys(texts, name, words, end):
    from weft.llm.tokens import Encoder

    tok, more = Tokenizer.from_file(public_tokenizers.path(name)), ["12a3!? b", " lead", "trail ", "a\n\nb", "don't", "x  y", "ÀÉ Öß×", "q" * 5000]
    enc = Encoder(public_tokenizers.path(name), words, most=50)
    for _ in range(2):
        got = enc.ids([*texts, *more])
        assert [g.tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in [*texts, *more]]


@pytest.mark.parametrize("name,words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_of_words_that_share_a_hash(name, words):
    from weft.llm.tokens import Encoder

    one = "a"
    while len(one) < 1024:  # a Thue-Morse word and its complement have one polynomial hash modulo 2**64, for any base
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    enc, tok = Encoder(public_tokenizers.path(name), words), Tokenizer.from_file(public_tokenizers.path(name))
    for texts in ([one], [other + " b"], [one + " " + other, "plain"], [other, one]):
        assert [g.tolist() for g in enc.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name,words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_memo_of_pre_tokens(monkeypatch, name, words):
    """Words that had one polynomial hash are told apart in a block; a hash that really is shared gives up the block, not the ids."""
    from weft.llm import tokens

    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    both = one + " " + one.translate(str.maketrans("ab", "ba"))
    assert tokens.Encoder(public_tokenizers.path(name), words)._block([both.encode()]) is not None
    tok, texts = Tokenizer.from_file(public_tokenizers.path(name)), [both, " ".join(f"{k:x}.\nwörd{'x' * (k % 30)}{chr(97 + k % 26)}" for k in range(9000)), " ", "!", "abcdefgh abcdefghi abcdefg ÿ"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    whole = tokens.Encoder._hash
    for few in (1 << 64, 1 << 12, 1):  # so many hashes
        monkeypatch.setattr(tokens.Encoder, "_hash", lambda self, *a, few=few: whole(self, *a) // np.uint64(max(1, (1 << 64) // few - (few == 1))))
        enc = tokens.Encoder(public_tokenizers.path(name), words)
        for t in ([texts, texts[::-1]]):
            assert [g.tolist() for g in enc.ids(t)] == (want if t is texts else want[::-1])


def test_plain_texts():
    import re

    from weft.llm.tokens import plain

    odd = re.compile(r"[^\n !-&(-;=-~À-ÖØ-öø-ÿ]|  |\n | \n|\n\n")
    for t in [*map(chr, [*range(0xD800), *range(0xE000, 0x11000)]), *(a + b for a in " \n\tx×Ã" for b in " \n\r-÷\x97")]:
        assert plain(t.encode()) == (not odd.search(t)), repr(t)


def test_memo_lasts(monkeypatch):
    """700,000 different pre-tokens, more than the memo once held, go to the library's model once."""
    from itertools import islice, product

    from weft.llm.tokens import Encoder

    monkeypatch.setattr(Encoder, "held", {})
    enc = Encoder.of(public_tokenizers.path("byte_bpe_50k.json"), False)
    learnt, learn = [], enc._learn
    enc._learn = lambda keys, *a: (learnt.append(len(keys)), learn(keys, *a))
    text = " ".join(map("".join, islice(product("abcdefghijklmno", repeat=5), 700_000)))
    first, again = enc.ids([text, text])
    assert sum(learnt) < 701_000 and (first == again).all() and enc._held() < enc.most


def test_inverse():
    a = np.random.default_rng(0).normal(size=(40, 40))
    a[0, 0] = 0.0
    assert np.allclose(packing.inverse_of(a) @ a, np.eye(40))


def test_packing(spark, docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    rows = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), True, 1, 2048), 2048).collect()
    for k, want in enumerate(ids):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(want) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held)))
    assert packing.pack(packing.pieces(empty(spark), public_tokenizers.path("word_bpe_49k.json"), True, 1, 2048)).count() == 0


@pytest.mark.parametrize("n", [3, 40, 3000])
def test_cutting_stock_meets_demand_near_the_bound(n):
    size, demand = np.unique(np.random.default_rng(n).integers(1, 65, n), return_counts=True)
    cut = packing.cutting_stock(size, demand.astype(float), 64)
    assert (sum(c * k for c, k in cut) >= demand).all() and all(c @ size <= 64 for c, _ in cut)
    assert sum(k for _, k in cut) <= 1.02 * (size @ demand) / 64 + 3 + 0.1 * len(size)


def test_licenses(spark, docs):
    got = licenses.license_spans(docs).collect()
    assert [(r.template, r.start, r.end) for r in got] == [("mit-line", 0, 30)]
    index, mit = licenses.Index(licenses.TEMPLATES), licenses.TEMPLATES["mit"]
    edited = mit.replace("free of charge", "gratis").replace("sublicense", "x y sublicense")
    found = licenses.scan(f"head words {edited} tail", index, 0.8)
    assert [f[0] for f in found] == ["mit"] and found[0][3] == 11 and 0.9 < found[0][1] < 1
    for name, t in licenses.TEMPLATES.items():
        assert name in {f[0] for f in licenses.scan(f"a b {t} c", index, 0.8)}
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 3, 4, 9])
    assert licenses.align(a, b, 4) == (3, 1, 4)
    assert licenses.license_spans(empty(spark)).count() == 0


def test_licenses_short_templates_and_places():
    index = licenses.Index({"one": "Unlicense", "two": "Public domain", "three": "all rights reserved"})
    text = "İİİİ free Unlicense, PUBLIC domain; all rights reserved"
    assert [(t, text[a:b]) for t, _, _, a, b in licenses.scan(text, index, 0.8)] == [("one", "Unlicense"), ("two", "PUBLIC domain"), ("three", "all rights reserved")]
    assert licenses.scan("domain public", index, 0.8) == []


def test_licenses_found_where_brute_force_finds_them():
    rng = np.random.default_rng(21)
    vocabulary = list("abcdefgh")
    for _ in range(60):
        templates = {str(k): " ".join(rng.choice(vocabulary, int(rng.integers(1, 9)))) for k in range(3)}
        index = licenses.Index(templates)
        doc = rng.choice([*vocabulary, "x", "y", "z", "w"], 30).tolist()
        name = str(rng.integers(3))
        own = templates[name].split()
        if rng.random() < 0.7:
            at = int(rng.integers(0, 20))
            doc[at : at + len(own)] = [w if rng.random() < 0.9 else "q" for w in own]
        got = {r[0] for r in licenses.scan(" ".join(doc), index, 0.8)}
        for n, t in templates.items():
            t = t.split()
            size = len(t) + 2 * licenses.band_of(len(t))
            best = max(plain_lcs(t, doc[k : k + size]) for k in range(-size, len(doc)) if k >= 0)
            if n in got:
                assert best >= 0.8 * len(t)
            elif max(plain_lcs(t, doc[k : k + len(t)]) for k in range(len(doc))) >= 0.8 * len(t):
                raise AssertionError((n, t, doc))


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_toxic_spans_are_those_of_the_text():
    model = toxicity.Model({"vile": (9.0, 3.0)}, fit=(-3.0, 2.0, 2.0))
    text = "İİİİİİİİİİ it is a Vile vile thing"
    _, _, found = model.evidence(model.scores(text))
    assert [text[a:b] for a, b, _ in toxicity.spans(text, found)] == ["Vile vile"]


def test_licenses_edited_short_notices():
    index = licenses.Index(licenses.TEMPLATES)
    found = licenses.scan("It is Released under an MIT License now", index, 0.8)
    assert found == [("mit-line", 0.8, 4, 6, 35)]
    for name, t in licenses.TEMPLATES.items():
        words = licenses.WORD.findall(t.lower())
        if len(words) < 16:
            for step in range(len(words)):
                edits = [(step + 5 * k) % len(words) for k in range(len(words) // 5)]
                text = " ".join("zz" if k in edits else w for k, w in enumerate(words))
                got = [f for f in licenses.scan(f"a b {text} c d", index, 0.8) if f[0] == name]
                assert [f[2] for f in got] == [len(words) - len(set(edits))], (name, edits)
    long = licenses.WORD.findall(licenses.TEMPLATES["isc"].lower())
    text = " ".join("zz" if k % 5 == 4 else w for k, w in enumerate(long))
    assert [f[0] for f in licenses.scan(text, index, 0.8)] == ["isc"]
    both = "released under an mit license released under the mit license released under an mit license"
    assert [f[2] for f in licenses.scan(both, index, 0.8)] == [4, 5, 4]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((gone, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix(spark, docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = by_id(suffix.remove_repeats(docs))
    for k, (gone, kept) in enumerate(brute_repeats(texts, 200)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) and bytes(r.text) == kept


def test_suffix_empty_and_repeated(spark, docs):
    assert suffix.remove_repeats(empty(spark)).count() == 0
    twice = docs.where("doc_id = 10").unionByName(docs.where("doc_id = 10"))
    got = suffix.remove_repeats(twice).collect()
    assert len(got) == 2 and all(r.n_removed == (r.n_bytes if r.n_bytes >= 200 else 0) for r in got)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in range(60):
        s = rng.integers(1, 4, n)
        assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 8)).astype(np.float32)
    x[20:50] = x[rng.integers(0, 8, 30)] + rng.normal(scale=0.05, size=(30, 8)).astype(np.float32)
    x[50:55] = x[0]
    vectors = [v.tolist() for v in x] + [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    labels = [k % 2 for k in range(80)] + [0] * 7
    labels[7] = None
    rows = [(k, v, l, 1) for k, (v, l) in enumerate(zip(vectors, labels))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    ok = [(i, j) for i in range(80) for j in range(i) if y[i] @ y[j] >= 0.98 and labels[i] == labels[j] and labels[i] is not None]
    links, root = Counter(k for p in ok for k in p), roots(87, ok)
    for block in (1024, 4):
        got = by_id(covertree.near_embeddings(table, block=block), "vec_id")
        assert len(got) == 87
        for k in range(87):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (links[k], root[k], root[k] == k), (block, k)
    assert covertree.near_embeddings(table.where("vec_id < 0")).count() == 0


def test_simhash(spark, docs, texts):
    def plain(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [plain(t) for t in texts]
    for radius in (4, 24):
        got = by_id(simhash.simhash(docs, radius=radius))
        root = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= radius])
        assert [(got[k].fingerprint, got[k].component_id) for k in range(len(fp))] == [(f"{f:016x}", r) for f, r in zip(fp, root)]
    assert simhash.simhash(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 5, 1])
def test_simhash_links(spark, chunk):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 12)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(60, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(8)})
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, chunk).collect()
    near = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & ((1 << 64) - 1)).bit_count() <= 4]
    at = {v: k for k, v in enumerate(values)}
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 1 << 6 for r in found)
    assert roots(len(values), [(at[r.a], at[r.b]) for r in found]) == roots(len(values), near)


def test_keep_first_tells_rows_of_one_id_apart(spark):
    a, b, c = (sentence(np.random.default_rng(k), 40) for k in (31, 32, 33))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 4), (8, c, 1), (None, b, 9), (None, None, 1), (9, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th long")
    left = sorted(map(tuple, simhash.keep_first(df).collect()), key=str)
    assert left == sorted([(3, a, 1), (7, c, 4), (None, b, 9), (None, None, 1)], key=str)
    assert simhash.keep_first(df.where("doc_id < 0")).columns == df.columns


@pytest.mark.parametrize("chunk", [4096, 5])
def test_linked_copies(spark, monkeypatch, chunk):
    """The pipeline's stage links by SimHash: by two fingerprints, as plain comparison of all pairs does."""
    rng = np.random.default_rng(14)
    texts = [None, "", "one two", " ".join(["again"] * 50)]
    for n in (30, 60, 150, 150):
        w = sentence(rng, n).split()
        for edits in range(8):
            v = list(w)
            for k in rng.integers(0, n, n * edits // 60):
                v[k] = sentence(rng, 1) + "x"
            texts.append(" ".join(v))
    first = [simhash.shingles((t or "").encode(), 3) for t in texts]
    both = [(simhash.majority(s), simhash.majority((s ^ (s >> np.uint64(29))) * simhash.MIX)) for s in first]
    apart = lambda i, j: [(x ^ y).bit_count() for x, y in zip(both[i], both[j])]
    root = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if apart(i, j)[0] <= 12 and sum(apart(i, j)) <= 28])
    assert 8 < len(set(root)) < len(texts) - 8
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(simhash.linked_copies(docs))
    assert [(got[k].component_id, got[k].kept) for k in range(len(texts))] == [(r, r == k) for k, r in enumerate(root)]
    assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()} == set(root)
    assert simhash.linked_copies(docs.where("doc_id < 0")).count() == 0


def test_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [None, "", "one two", "one two", " ".join(["again"] * 50)]
    for n in (6, 30, 60, 150, 150, 400):
        w = sentence(rng, n).split()
        texts.append(" ".join(w))
        for edits in range(1, 9):
            v = list(w)
            for k in rng.integers(0, n, max(1, n * edits // 200)):
                v[k] = sentence(rng, 1) + "x"
            texts.append(" ".join(v))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(sets), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for chunk in (simhash.CHUNK, 4):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = by_id(simhash.near_copies(docs))
        assert [got[k].component_id for k in range(len(texts))] == root
    alone = by_id(simhash.simhash(docs, width=5, radius=8))
    assert [alone[k].component_id for k in range(len(texts))] != root
    assert simhash.near_copies(docs.where("doc_id < 0")).count() == 0


def test_decontamination(spark, docs, texts):
    words = [decontam.words((t or "").encode()) for t in texts]
    items = [(0, texts[8]), (1, "one"), (2, None), (3, ""), (4, " ".join(w.decode() for w in words[43][100:130])), (5, "zz " + texts[10]), (5, texts[12])]
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    want = {}
    for k, doc in enumerate(words):
        hit, found = np.zeros(len(doc), bool), set()
        for i, t in items:
            for w in decontam.windows(decontam.words((t or "").encode()), 13):
                for at in range(len(doc) - len(w) + 1):
                    if tuple(doc[at : at + len(w)]) == w:
                        hit[at : at + len(w)] = True
                        found.add(str(i))
        want[k] = (len(doc), int(hit.sum()), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit.any()) and 20 * int(hit.sum()) >= len(doc))
    got = by_id(decontam.decontaminate(docs, bench))
    assert {k: tuple(r)[1:] for k, r in got.items()} == want
    again = docs.unionByName(docs.where("doc_id = 8")).unionByName(docs.where("doc_id = 8").withColumn("text", F.lit("clean words")))
    left = decontam.keep_clean(again.withColumnRenamed("name", "_id"), bench)
    assert sorted(r.doc_id for r in left.collect()) == sorted([k for k, w in want.items() if not w[4]] + [8]) and "_id" in left.columns
    bare = decontam.decontaminate(docs.where("doc_id = 8"), bench.withColumn("item_id", F.lit(None).cast("long"))).first()
    assert bare.n_hit == want[8][1] and bare.n_items == 0 and bare.items_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(w[4] for w in want.values()) > 2
    assert decontam.decontaminate(docs, bench.where("item_id < 0")).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty(spark), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_token_files(spark, docs, texts, block):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    twice = docs.unionByName(docs.where("doc_id IN (8, 43)")).unionByName(docs.where("doc_id = 9").withColumn("text", F.lit("another")))
    rows = sorted(binary.round_trip(twice, public_tokenizers.path("byte_bpe_50k.json"), block_ids=block).collect(), key=lambda r: (r.doc_id, r.start))
    want = sorted([(k, t) for k, t in enumerate(texts)] + [(8, texts[8]), (43, texts[43]), (9, "another")], key=lambda x: x[0])
    assert [r.doc_id for r in rows] == [k for k, _ in want]
    at, ids_of = 0, {}
    for k, t in want:
        ids_of.setdefault(k, []).append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        crc = [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids_of[r.doc_id] if len(i) == r.n_tokens]
        assert r.ids_crc32 in crc
        ids_of[r.doc_id].pop(next(k for k, i in enumerate(ids_of[r.doc_id]) if zlib.crc32(np.array(i, "<u4").tobytes()) == r.ids_crc32))
    assert not any(ids_of.values())
    assert binary.round_trip(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_large_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {f"w{k}": k for k in range(70_000)}
    big = Tokenizer(models.WordLevel(words, unk_token="w0"))
    big.pre_tokenizer = pre_tokenizers.Whitespace()
    big.save(f"{tmp_path}/big.json")
    assert (binary.width_of(f"{tmp_path}/big.json"), binary.width_of(public_tokenizers.path("byte_bpe_50k.json"))) == ("<u4", "<u2")
    docs = spark.createDataFrame([(1, "w5 w69999 w65536 w0"), (2, "w65541")], "doc_id long, text string")
    path = binary.table_path(spark, "big")

    class Plain:
        def ids(self, texts):
            return [np.array([int(w[1:]) for w in (t or "").split()], np.uint32) for t in texts]

    def tokens(batches, **args):
        import weft.llm.binary as own

        own.Encoder.of = classmethod(lambda cls, path, words: Plain())
        yield from TOKENS(batches, **args)

    TOKENS, binary._tokens = binary._tokens, tokens
    try:
        binary.write_ids(docs, path, f"{tmp_path}/big.json", 3)
    finally:
        binary._tokens = TOKENS
    rows = sorted(binary.read_ids(spark, path).collect())
    want = [[5, 69999, 65536, 0, 3], [65541, 3]]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in want] and [r.start for r in rows] == [0, 5]


def test_crc_of_pieces():
    a, b, c = b"first piece", b"the second", b"x" * 1000
    moved = binary.crc_after(zlib.crc32(a), len(b + c)) ^ binary.crc_after(zlib.crc32(b), len(c)) ^ zlib.crc32(c)
    assert moved == zlib.crc32(a + b + c)


@pytest.mark.parametrize("n,kinds", [(1, 1), (5, 1), (3000, 2), (70_000, 3000)])
def test_huffman_round_trip(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype(np.int64)
    counts = np.bincount(ids, minlength=1 << 16)
    lengths = binary.code_lengths(counts)
    assert lengths.max() <= binary.LIMIT and sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    bits, marks = binary.encode(ids, lengths, binary.canonical(lengths))
    assert (binary.decode(bits, marks, n, binary.decoder(lengths)) == ids).all()


def test_huffman_limit():
    lengths = binary.code_lengths(np.array([2**k for k in range(40)]))
    assert lengths.max() == binary.LIMIT and sum(2.0 ** -int(x) for x in lengths) <= 1


PAGE = """<!DOCTYPE html><html><head><title>T t</title><style>p{}</style><script>var t="</p><p>not this text at all</p>";</script></head><body>
<header><h2>Site name here</h2></header><nav><ul><li><a href="/a">Home page</a></li><li><a href='/b>c'>About us</a></li></ul></nav><div class="cookie-notice">We use cookies, do you agree?</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;paragraph <b>bold</b> with
 a <a href="x">link</a> inside.<p>Second &#233; one<br>goes on and on.</p><div class="ad">Buy this now please</div><ul><li>Item one is here</li></ul></article>
<section id="comments"><p>I like this article very much indeed, thanks</p></section><form>Your name <input></form><footer>All rights reserved</footer></body></html>"""


def test_extract(spark):
    want = "Title & more\n\nFirst paragraph bold with a link inside.\n\nSecond é one goes on and on.\n\nItem one is here"
    assert extract.extract(PAGE, extract.FIXED) == want
    plain = PAGE.replace("<article>", "<div class=content>").replace("</article>", "</div>")
    assert extract.extract(plain, extract.FIXED) == want
    pages = spark.createDataFrame([(0, "u", PAGE, "x"), (1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>", "x"), (4, "u", PAGE, "x"), (5, "u", "plain words only", "x"), (6, "u", "<article><p>" + "long text here " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = by_id(extract.main_text(pages), "page_id")
    assert [got[k].text for k in range(6)] == [want, "", "", "", want, "plain words only"] and got[6].n_chars == 15 * 50_000 - 1
    assert extract.main_text(pages.where("page_id < 0")).count() == 0


KEPT = """<html><body><div class="header"><a href=/>Home page</a></div><nav><a href=1>One two</a></nav><div class="cookie-notice">We use cookies on this site to give you the best experience, and by going on you agree to all of that.</div>
<article><h1>Main</h1><p>First words of the article are here and go on.</p><h2 id="discussion">Discussion</h2><p>We discuss it here at length in a paragraph.</p><section id="related-work"><h2>Related work</h2><p>Others did some of this before us.</p></section>
<div class="search-results"><p>Three hits were found in all.</p></div><div class="ad">Buy this now please, and more of it, and then some more of that</div><p>After that a paragraph, with <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><g><text>drawn words</text></g></svg>.</p>
<div class="related"><a href=1>Other story one</a> <a href=2>Other story two</a></div><object>fallback text</object><canvas>more of it</canvas><p>Bye.</p></article>
<section class="comments"><p>I like it very much indeed and would say more here and there.</p></section><div class="share">Share this</div><footer>All rights</footer></body></html>"""


def test_extract_keeps_what_is_the_articles():
    blocks = extract.extract(KEPT, extract.FIXED).split("\n\n")
    assert blocks == ["Main", "First words of the article are here and go on.", "Discussion", "We discuss it here at length in a paragraph.", "Related work", "Others did some of this before us.", "Three hits were found in all.", "After that a paragraph, with x=1 and drawn words.", "fallback text", "more of it", "Bye."]
    plain = extract.extract(KEPT.replace("article>", "div>"), extract.FIXED).split("\n\n")
    assert plain[:8] == blocks[:8]


def test_best_region():
    rng = np.random.default_rng(9)
    for _ in range(300):
        s = rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0], int(rng.integers(0, 14))).tolist()
        every = [(sum(s[a:b]), -a, a - b, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if sum(s[a:b]) > 0]
        start, end = extract.best_region(s)
        assert sum(s[start:end]) == (max(every)[0] if every else 0) and (every or (start, end) == (0, 0))


def test_extract_is_linear():
    for part in ("<a ", "<a>", '<a "', "<a '>", "<!--", "<noscript>", '<a href="x>', "<div class='ad'>", "<div class='related'>x ", "</div>", "<p id=q>"):
        began = time.time()
        extract.extract(part * (1_000_000 // len(part)), extract.FIXED)
        assert time.time() - began < 30


def test_extract_learns_names_outside_of_articles(spark):
    page = "<html><body><div class=strap>Words {} of a strap line that is not marked in any known way</div>{}<p>Article words {} go on for long enough here.</p>{}</body></html>"
    rows = [(k, page.format(k, "<article>", k, "</article>")) for k in range(30)] + [(99, page.format(99, "<div>", 99, "</div>")), (100, "<article><p>" + "long text here " * 100_000)]
    got = by_id(extract.main_text(spark.createDataFrame(rows, "page_id long, html string"), keep=()), "page_id")
    assert all(got[k].text == f"Article words {k} go on for long enough here." for k in [*range(30), 99])
    assert got[100].n_chars == 15 * 100_000 - 1


def repeated_words(k, raw, least, most):
    """Spans of text k, in whole words, that equal an earlier place and are long enough: every shift against every text."""
    text = np.frombuffer(raw[k], np.uint8)
    spots = [m.span() for m in re.finditer(rb"\S+", raw[k])]
    out = np.zeros(len(text) + 2, np.int8)
    for j in range(k + 1):
        other = np.frombuffer(raw[j], np.uint8)
        for shift in range(-len(text) + 1, 0 if j == k else len(other)):
            low, high = max(0, -shift), min(len(text), len(other) - shift)
            if high - low < 2 * least - 1:
                continue
            same = np.concatenate([[0], (text[low:high] == other[low + shift : high + shift]).astype(np.int8), [0]])
            edge = np.flatnonzero(np.diff(same)) + low
            for x, z in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                own = [w for w in spots if x <= w[0] and w[1] <= z]
                if own and (len(own) >= least or own[-1][1] - own[0][0] >= most):
                    out[own[0][0] + 1 : own[-1][1] + 1] = 1
    edge = np.flatnonzero(np.diff(out))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def test_chunks(spark, docs, texts):
    raw = [(t or "").encode() for t in texts]
    ends, _ = chunks.cuts(raw)
    assert all((np.diff(e, prepend=0) > 0).all() and (e[-1:] == len(t)).all() for e, t in zip(ends, raw))
    assert [e.tolist() for e in ends] == [chunks.cuts([t])[0][0].tolist() for t in raw]
    long = {42, 43, 45}  # periodic, too long, or without spaces, for the plain version
    some = [t if j not in long else b"" for j, t in enumerate(raw)]
    want = {k: repeated_words(k, some, 50, 600) for k in range(len(raw)) if k in {30, 36, 39, 40, 41}}
    got = by_id(chunks.dedup(docs))
    for k, gone in want.items():
        kept = chunks._cut(raw[k], gone)
        assert (k, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (k, sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest())
    assert got[0].text is None and sum(map(bool, want.values())) >= 3
    assert got[45].n_removed == len(raw[45]) - 24  # one period of eight characters stays
    assert len(raw[42]) - 23 >= got[42].n_removed >= 275  # a chunk of two periods stays, and the last space
    left = by_id(chunks.apply(docs, chars_col="n"))
    assert all(left[k].text == got[k].text and left[k].lang == "en" and (k == 0 or left[k].n == len(got[k].text)) for k in range(len(raw)))
    assert chunks.apply(docs).columns == docs.columns and chunks.dedup(empty(spark)).count() == 0


def test_chunks_find_passages_of_any_length(spark):
    rng = np.random.default_rng(11)
    n, sizes = 120, [51, 52, 55, 60, 70, 49, 40, 30]
    passages = [sentence(rng, sizes[k % 8]) for k in range(n)]
    rows = [(k, sentence(rng, int(rng.integers(20, 60))) + ". " + p + " " + sentence(rng, 40)) for k, p in enumerate(passages)]
    rows += [(1000 + k, sentence(rng, int(rng.integers(20, 60))) + " " + p + "\n" + sentence(rng, 40)) for k, p in enumerate(passages)]
    got = by_id(chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, p in enumerate(passages):
        assert got[k].n_removed == 0 and got[1000 + k].n_removed == (len(p) if sizes[k % 8] >= 50 else 0)


def test_chunks_clashing_names(spark):
    rows = [(1, "a " * 400, 3, 4, 5, 6), (1, "a " * 400, 3, 4, 5, 6), (None, None, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "id long, t string, th long, z long, n long, _th long")
    got = sorted(chunks.apply(df, "id", "t", "n").collect(), key=lambda r: r.id or 0)
    assert [len(r) for r in got] == [6] * 3 and got[0].t is None and got[1] == got[2] and got[1].th == 3 and got[1].n == len(got[1].t) < 800


def test_chunks_resist_insertion():
    rng = np.random.default_rng(8)
    spaced = sentence(rng, 3000).encode()
    unspaced = "".join(map(chr, rng.integers(0x4E00, 0x9000, 20_000))).encode()
    solid = "".join(map(chr, rng.integers(97, 123, 20_000))).encode()
    for text in (spaced, unspaced, solid):
        cut = [chunks.cuts([t])[0][0] for t in (text, text[3000:3003] + text[:6000] + text[:9] + text[6000:])]
        parts = [set(t[a:b] for a, b in zip(np.concatenate([[0], e[:-1]]).tolist(), e.tolist())) for t, e in zip((text, text[3000:3003] + text[:6000] + text[:9] + text[6000:]), cut)]
        assert len(parts[0]) > 100 and len(parts[0] & parts[1]) > 0.95 * len(parts[0])
        assert max(np.diff(e, prepend=0).max() for e in cut) <= 2 * chunks.WINDOW


def test_segments_are_maximal():
    s = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])
    assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(0, 1), (2, 3), (4, 11)]
    rng = np.random.default_rng(4)
    for _ in range(50):
        s = rng.integers(-4, 4, 30).astype(float)
        best = max((s[a:b].sum() for a in range(30) for b in range(a + 1, 31)), default=0)
        assert max((x for *_, x in toxicity.segments(s)), default=0) == max(best, 0)


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    bad = ["vile", "rotten", "awful"]
    texts = [sentence(rng, 60) for _ in range(400)]
    toxic = rng.random(400) < 0.3
    texts = [t + " " + " ".join(rng.choice(bad, 4)) if y else t for t, y in zip(texts, toxic)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(400, None, 1), (401, "", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, int(y), 1) for k, y in enumerate(toxic)] + [(0, None, 1), (None, 1, 1), (3, int(toxic[3]), 0)], "doc_id long, toxic int, quality int")
    got = by_id(queries.toxic_scores(docs, labels))
    assert len(got) == 402 and all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert np.mean([got[k].predicted == int(y) for k, y in enumerate(toxic) if got[k].held_out]) > 0.95
    assert got[400].score == got[401].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    none = queries.toxic_scores(docs, labels.where("doc_id < -5"))
    assert {r.score for r in none.collect()} <= {none.first().score} and none.first().score < 0.01
    model = toxicity.Model({"vile": (9.0, 3.0)}, fit=(-3.0, 2.0, 2.0))
    _, _, found = model.evidence(model.scores("it is a vile vile vile thing"))
    assert [x[:2] for x in toxicity.spans("it is a vile vile vile thing", found)] == [(8, 22)]
    assert queries.toxic_scores(docs.where("doc_id < 0"), labels).count() == 0


def test_pipeline_edges(spark, tmp_path):
    a, b, item = (sentence(np.random.default_rng(k), 60) for k in (41, 42, 43))
    rows = [(3, a, 1, "x"), (5, a, 2, "x"), (5, b, 3, "x"), (5, b, 3, "x"), (6, item, 1, "x"), (6, "short text", 1, "x"), (None, None, 1, None), (8, "", 1, "y")]
    schema = "doc_id long, text string, _th long, id string"
    for name, docs, bench in (("full", rows, [(1, item)]), ("none", [], []), ("nobench", rows, [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(6, 0, 0), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = Counter((r.doc_id, r.doc_tokens > 1) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
        want = {"full": {(3, True): 1, (5, True): 1, (6, True): 1, (None, False): 1}, "none": {}, "nobench": {(3, True): 1, (5, True): 1, (6, True): 2, (None, False): 1}}[name]
        assert got == want


def test_pipeline(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, fixture_texts()[8])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, kept = docs.select("doc_id", "text", "lang"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang"]
        table = spark.createDataFrame(table.collect(), "doc_id long, text string, lang string")
        kept.append({r.doc_id: r.text for r in table.collect()})
    assert len(kept[0]) == len(fixture_texts()) and {36, 37} & kept[1].keys() == set() and 6 in kept[1]
    assert kept[2].keys() == kept[1].keys() and len(kept[2][41]) < len(kept[1][41])
    assert 8 in kept[2] and 8 not in kept[3]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == kept[3].keys()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept[3].values())


@pytest.mark.parametrize("n,kinds", [(4, 2), (61, 1), (301, 2)])
def test_distributed_suffix_sort(spark, n, kinds):
    s = np.random.default_rng(n).integers(1, kinds + 1, n).tolist()
    df = spark.createDataFrame([(k, int(c)) for k, c in enumerate(s)], "pos long, c long").repartition(3)
    got = [r.pos for r in sorted(dcover.ranks(df, n, 40).collect(), key=lambda r: r["rank"])]
    assert got == sorted(range(n), key=lambda k: s[k:])


def test_distributed_repeats(spark):
    rng = np.random.default_rng(5)
    passage = sentence(rng, 12)
    texts = [sentence(rng, 8) + passage, None, "", passage + sentence(rng, 6), sentence(rng, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    seen = Counter(t.encode()[k : k + 40] for t in texts if t for k in range(len(t) - 39))
    want = {(d, k) for d, t in enumerate(texts) if t for k in range(len(t) - 39) if seen[t.encode()[k : k + 40]] > 1}
    assert {tuple(r) for r in dcover.repeated(df, length=40, small=60).collect()} == want and want
