"""SimHash near-duplicates: exact Hamming-radius links by tiled exclusive-or and bit counts.

Fingerprints are collapsed to distinct values, sorted into tiles by the population counts of their two halves, and
only tile pairs whose counts differ by the radius or less are compared: the difference of population counts is a
lower bound of the Hamming distance. Tiles are cut into chunks of bounded size, so no task holds an unbounded tile, and
each comparison returns a spanning forest of its links rather than all pairs, which leaves the components unchanged.

Null and empty texts have fingerprint zero and link like any other; repeated rows share a fingerprint; an empty table
gives no rows; columns other than the id and the text are not read, whatever their names. Equal fingerprints are ties and
share the smallest id; very long texts are hashed whole.

linked_copies() has a second fingerprint, so that a larger radius links no unrelated texts; the pipeline goes through it.
near_copies() links by the exact Jaccard similarity of the sets of shingles instead; fingerprints only thin its candidates.
These are as many as a group of unlike texts that share a hash has pairs, so it is not for large corpora.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, few, fresh, local_roots, trim

CHUNK, GROUP = 4096, 4
#: From the hash of a shingle to another one.
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words; a shorter text is one run, an empty one has none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    view = memoryview(joined)
    return np.array([digest(view[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], dtype=np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit fingerprint: majority over the XXH64 (seed 42) of all word shingles, repeats included."""
    return majority(shingles(text, width))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(lanes) < 192:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): one row per row of docs."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


def compare(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], same: bool, radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of a and b (or within a) as places in a followed by b, reduced to a spanning forest.

    a, b: a uint64 array, or two of second fingerprints too; those of a link differ in `total` bits at most over both.
    """
    left, right, n = [], [], len(a[0])
    step = max(1, (1 << 17) // max(1, len(b[0])))
    shape = min(step, n), len(b[0])
    xor, bits, near = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, bool)
    for at in range(0, n, step):
        m = min(step, n - at)
        np.bitwise_xor(a[0][at : at + m, None], b[0][None, :], out=xor[:m])
        np.bitwise_count(xor[:m], out=bits[:m])
        np.less_equal(bits[:m], radius, out=near[:m])
        if not near[:m].any():
            continue
        i, j = np.nonzero(near[:m])
        i = i + at
        keep = i < j if same else np.ones(len(i), bool)
        if len(a) > 1:
            keep &= sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(a, b)) <= total
        i, j = i[keep], j[keep]
        left.append(i)
        right.append(j if same else j + n)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = local_roots(n if same else n + len(b[0]), np.concatenate(left), np.concatenate(right))
    child = np.nonzero(root != np.arange(len(root)))[0]
    return child, root[child]


def links(values: DataFrame, radius: int = 4, chunk: int | None = None, total: int | None = None) -> DataFrame:
    """Forest of links (a, b) between the distinct longs in values.fp that differ in radius bits or fewer.

    Where `total` is given, values has second fingerprints in fq: linked rows differ in `total` bits at most over both, and
    are named by their node_key.

    A tile's chunks are gathered in groups of GROUP, and each pair of groups of two near tiles is a key of its own, so the
    work of a large tile is dealt to many tasks. Tasks are as many as the comparisons ask for, whatever the rows' bytes.
    Tiles are wider for a larger radius, so that each has about as many near ones.
    """
    spark, chunk, cell = values.sparkSession, chunk or CHUNK, max(1, radius // 4)
    words = ["fp"] if total is None else ["fp", "fq"]
    count = lambda c: F.floor(F.bit_count(c) / cell).cast("int")
    v = values.select(*words, count(F.shiftrightunsigned("fp", 32)).alias("hi"), count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    tiles = {(r.hi, r.lo): r.n for r in v.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 x 33 rows at most
    least = lambda d: (abs(d) - 1) * cell + 1 if d else 0
    near = [(h, k) for h in range(0, radius + 1) for k in range(-radius, radius + 1) if least(h) + least(k) <= radius and (h > 0 or k >= 0)]
    work = sum(n * tiles.get((hi + h, lo + k), 0) for (hi, lo), n in tiles.items() for h, k in near)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, work >> 27))
    sizes = spark.createDataFrame([(*t, -(-n // chunk), -(-n // (chunk * GROUP))) for t, n in tiles.items()], "hi int, lo int, chunks long, groups long")
    v = v.join(F.broadcast(sizes.select("hi", "lo", "chunks")), ["hi", "lo"]).withColumn("salt", F.pmod(F.xxhash64(*words), "chunks"))
    chunks = checkpoint(v.groupBy("hi", "lo", "salt").agg(F.flatten(F.collect_list(F.array(*words))).alias("fps")))
    offsets = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in near])
    group = F.floor(F.col("salt") / GROUP).cast("long")

    def side(sign: int, own: str, other: str, fps: str) -> DataFrame:
        """Chunks by the pair of tiles (named by its lower one and the offset) and the pair of groups they belong to."""
        x = chunks.select("hi", "lo", "salt", F.col("fps").alias(fps), F.explode(offsets).alias("o"))
        far = sizes.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "groups")
        x = x.join(F.broadcast(far), (F.col("_hi") == F.col("hi") + sign * F.col("o.h")) & (F.col("_lo") == F.col("lo") + sign * F.col("o.k")))
        first = "hi", "lo"
        return x.select(*[F.col(c if sign > 0 else "_" + c).alias(c) for c in first], F.col("o.h").alias("h"), F.col("o.k").alias("k"), group.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias(other), F.col("salt").alias("s" + own), fps)

    keys = ["hi", "lo", "h", "k", "ga", "gb"]
    same = (F.col("h") == 0) & (F.col("k") == 0)
    once = ~same | (F.col("ga") <= F.col("gb"))
    a, b = (side(*how).where(once).repartition(tasks, *keys) for how in ((1, "ga", "gb", "x"), (-1, "gb", "ga", "y")))
    pairs = a.join(b, keys).where(~same | (F.col("sga") <= F.col("sgb"))).select("x", "y", (same & (F.col("sga") == F.col("sgb"))).alias("self"))
    width = len(words)
    ends = [f"{s}{k}" for s in "ab" for k in range(width)]

    def run(batches):
        for p in batches:
            for k in range(p.num_rows):
                x, y = (p.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width) for c in (0, 1))
                own = p.column(2)[k].as_py()
                parts = [tuple(np.ascontiguousarray(t[:, w]) for w in range(width)) for t in (x, y)]
                i, j = compare(*parts, own, radius, total or radius)
                if len(i):
                    nodes = (x if own else np.concatenate([x, y])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at, w].copy()) for at in (i, j) for w in range(width)], names=ends)

    found = pairs.mapInArrow(run, ", ".join(f"{c} long" for c in ends))
    return found.select(F.col("a0").alias("a"), F.col("b0").alias("b")) if width == 1 else found.select(node_key("a0", "a1").alias("a"), node_key("b0", "b1").alias("b"))


def node_key(fp: str, fq: str) -> Column:
    """One long for two fingerprints."""
    return F.xxhash64(fp, fq)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fingerprint string, component_id): component_id is the smallest id reachable over links."""
    fp = checkpoint(fingerprints(docs, id_col, text_col, width))
    least = checkpoint(fp.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(links(least, radius))
    linked = least.join(comp, least.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    firsts = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    named = linked.join(firsts, "c").select("fp", "component_id")
    return fp.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def prefix_size(n: int, least: float) -> int:
    """Of two sets with a Jaccard similarity of `least` or more, so many of the smallest hashes of each share one.

    That is certain for all but least * n of a set's n hashes. But each of the smallest k hashes of the union is in both sets
    with a chance of `least`, whatever the sets, and all k miss with (1 - least) ** k: from the k on where that is below
    2 ** -64, the chance that two different shingles share a hash, more hashes add nothing.
    """
    enough = math.ceil(64 * math.log(2) / -math.log(1 - least)) if least < 1 else 1
    return min(n - math.ceil(least * n - 1e-9) + 1, enough) if n else 0


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """(id, th, key, n, fp, fq, prefix): th is a hash of the text, key of its set of shingles, fp and fq the set's fingerprint of 128 bits."""

    def run(batches):
        trim()
        for b in batches:
            key, n, fp, fq, prefix = [], [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                s = np.unique(shingles(t.as_py() or b"", width))
                key.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                n.append(len(s))
                fp.append(majority(s))
                fq.append(majority((s ^ (s >> np.uint64(29))) * MIX))
                prefix.append(s[: prefix_size(len(s), least)].view(np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            ends = np.cumsum([0] + [len(p) for p in prefix]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), longs(key), pa.array(n, pa.int32()), longs(fp), longs(fq), pa.ListArray.from_arrays(ends, np.concatenate([*prefix, np.empty(0, np.int64)]))], names=["id", "th", "key", "n", "fp", "fq", "prefix"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(run, "id long, th long, key long, n int, fp long, fq long, prefix array<long>")


def verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """Those of pairs (a, b) of keys whose sets of shingles have a Jaccard similarity of `least` or more."""
    wanted = checkpoint(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct().join(ids, "key").select("id").distinct())
    wanted, _ = few(wanted)  # where they are few, no text is shuffled

    def sets(batches):
        trim()
        for b in batches:
            rows = [np.unique(shingles(t.as_py() or b"", width)).tobytes() for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh3_64_intdigest(r) for r in rows], np.uint64).view(np.int64)), pa.array(rows, pa.binary())], names=["key", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(wanted, "id", "left_semi").select("t")
    found = checkpoint(texts.mapInArrow(sets, "key long, s binary").dropDuplicates(["key"]))
    both = pairs.join(found.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(found.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")

    def run(batches):
        for p in batches:
            keep = []
            for x, y in zip(p.column(2), p.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return checkpoint(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 40) -> DataFrame:
    """(id_col, th, component_id, kept): texts are linked where their sets of word shingles have a Jaccard similarity of `least`.

    Rows are told apart by the id and th, a hash of the text; kept marks the least of them in each component (a null id
    comes first), rows that repeat both alike.

    Candidates share one of the smallest hashes (prefix_size: this loses no more than hashing does), differ little enough in size, and
    have fingerprints within radius of 128 bits; their sets are then compared. First each text meets one text of each hash
    it has, so that large groups of copies are linked by few comparisons; then those that are not yet connected meet.
    """
    base = checkpoint(_sets(docs, id_col, text_col, width, least))
    ids = base.groupBy("key").agg(F.min("id").alias("id"))
    nodes = base.select("key", "n", "fp", "fq").dropDuplicates(["key"])
    tokens = base.select("key", "prefix").dropDuplicates(["key"]).select("key", F.explode("prefix").alias("token"))
    firsts = tokens.groupBy("token").agg(F.count("*").alias("many"), F.min("key").alias("first")).where("many > 1")
    shared = checkpoint(tokens.join(firsts, "token"))
    check = lambda pairs: verified(pairs, docs, ids, id_col, text_col, width, least)
    end = lambda s: nodes.select(*[F.col(c).alias(f"{c}{s}") for c in nodes.columns])
    stars = shared.where(F.col("key") != F.col("first")).select(F.col("first").alias("key1"), F.col("key").alias("key2")).distinct().join(end(1), "key1").join(end(2), "key2")
    bits = F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp2"))) + F.bit_count(F.col("fq1").bitwiseXOR(F.col("fq2")))
    stars = checkpoint(stars.where((F.least("n1", "n2") >= least * F.greatest("n1", "n2") - 1e-9) & (bits <= radius)).select(F.col("key1").alias("a"), F.col("key2").alias("b")))
    links = check(stars)
    comp = components(links).withColumnRenamed("node", "key")
    named = shared.join(nodes.join(comp, "key", "left"), "key").withColumn("c", F.coalesce("component", "key")).withColumn("salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("many") / CHUNK)).cast("int"))
    groups = named.groupBy("token", "salt").agg(F.collect_list("key").alias("key"), F.collect_list("n").alias("n"), F.collect_list("fp").alias("fp"), F.collect_list("fq").alias("fq"), F.collect_list("c").alias("c"), F.max("many").alias("many"))
    side = lambda s: [F.col(c).alias(f"{c}{s}") for c in ("salt", "key", "n", "fp", "fq", "c")]
    large = groups.where(F.col("many") > CHUNK)
    blocks = groups.select("token", *side(1), *side(2)).unionByName(large.select("token", *side(1)).join(large.select("token", *side(2)), "token").where("salt1 < salt2")).drop("token", "salt1", "salt2")

    def run(batches):
        for p in batches:
            found = []
            for k in range(p.num_rows):
                key, n, fp, fq, c, key2, n2, fp2, fq2, c2 = (p.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(10))
                step = max(1, (1 << 19) // max(1, len(key2)))
                for at in range(0, len(key), step):
                    part = slice(at, at + step)
                    near = (key[part, None] < key2) | (key[0] != key2[0])
                    near &= c[part, None] != c2
                    near &= np.minimum(n[part, None], n2) >= least * np.maximum(n[part, None], n2) - 1e-9
                    near &= np.bitwise_count((fp[part, None] ^ fp2).view(np.uint64)) + np.bitwise_count((fq[part, None] ^ fq2).view(np.uint64)) <= radius
                    i, j = np.nonzero(near)
                    a, b = key[part][i], key2[j]
                    found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    rest = checkpoint(blocks.mapInArrow(run, "a long, b long").distinct().join(stars, ["a", "b"], "left_anti"))
    comp = components(links.unionByName(check(rest)))
    linked = ids.join(comp, ids.key == comp.node, "left").select("key", F.coalesce("component", "key").alias("c"))
    rows = checkpoint(base.select("id", "th", "key").join(linked, "key").select("id", "th", "c"))
    firsts = rows.groupBy("c").agg(F.min(F.struct("id", "th")).alias("first"))
    return rows.join(firsts, "c").select(F.col("id").alias(id_col), "th", F.col("first.id").alias("component_id"), F.struct("id", "th").eqNullSafe(F.col("first")).alias("kept"))


def linked_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 12, total: int = 28) -> DataFrame:
    """(id_col, th, component_id, kept) as in near_copies(), by fingerprints alone: texts are linked where their fingerprints
    differ in `radius` bits or fewer, and in `total` or fewer together with second fingerprints of other hashes.

    Two unrelated texts are that close with a chance of about 1e-11; `radius` alone would link one pair in 5 million.
    """

    def run(batches):
        for b in batches:
            fp, fq = [], []
            for t in b.column(2).cast(pa.binary()):
                s = shingles(t.as_py() or b"", width)
                fp.append(majority(s))
                fq.append(majority((s ^ (s >> np.uint64(29))) * MIX))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, fq)]], names=["id", "th", "fp", "fq"])
        trim()

    text = F.col(text_col).cast("string")
    base = checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(run, "id long, th long, fp long, fq long"))
    least = checkpoint(base.groupBy("fp", "fq").agg(F.min(F.struct("id", "th")).alias("least")))
    comp = components(links(least, radius, total=total))
    named = least.withColumn("node", node_key("fp", "fq")).join(comp, "node", "left").select("fp", "fq", "least", F.coalesce("component", "node").alias("c"))
    named = checkpoint(named.join(named.groupBy("c").agg(F.min("least").alias("first")), "c").select("fp", "fq", "first"))
    return base.join(named, ["fp", "fq"]).select(F.col("id").alias(id_col), "th", F.col("first.id").alias("component_id"), F.struct("id", "th").eqNullSafe(F.col("first")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 12, total: int = 28) -> DataFrame:
    """One row of each component of linked_copies(), all columns: the least by id and text. Of rows that repeat both, the one
    whose columns come first as JSON stays."""
    names, (one, th, n) = docs.columns, fresh(docs.columns, "id", "th", "n")
    marked = linked_copies(docs, id_col, text_col, width, radius, total).groupBy(F.col(id_col).alias(one), F.col("th").alias(th)).agg(F.count("*").alias(n), F.max("kept").alias("kept"))
    other = checkpoint(marked.where(f"NOT kept OR {n} > 1"))  # all but the single rows that stay
    same = lambda x: docs[id_col].cast("long").eqNullSafe(x[one]) & (F.xxhash64(docs[text_col].cast("string")) == x[th])
    twice, n_twice = few(checkpoint(other.where("kept").select(one, th)))
    other, _ = few(other)
    single = docs.join(other, same(other), "left_anti")
    if not n_twice:
        return single.select(*names)
    rows = docs.join(twice, same(twice)).groupBy(one, th).agg(F.min_by(F.struct(*[F.col(c) for c in names]), F.to_json(F.struct(*[F.col(c) for c in names]))).alias("row"))
    return single.select(*names).unionByName(rows.select("row.*"))
