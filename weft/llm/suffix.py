"""Suffix-array dedup: every byte of a long repeated string goes.

Windows are dealt by anchors, and a difference-cover suffix sort within tasks of bounded size settles what differs around
an anchor. The suffix sort of the whole corpus is in dcover; it moves too much for the corpora at hand (see the README).

A string of LENGTH bytes (a window) that starts at two places is repeated; all bytes of repeated windows are removed.

1. Distribution. Each window is dealt by its anchor: the GRAM-byte run in it with the least hash, the leftmost if equal.
   The anchor depends on the window's bytes alone, so equal windows meet. Neighbouring windows with one anchor form a
   context of at most 2 * LENGTH - GRAM bytes. Anchors that occur once drop out; equal contexts are counted by digest,
   and copies among them are settled. That leaves the different contexts around one anchor.
2. Suffix sort. Contexts are gathered by anchor, and each gathering of bounded size is sorted by the difference cover
   modulo 3: sampled triples are sorted and named, names are sorted by recursion, the remaining suffixes are sorted by
   their first byte and the rank after it and merged in. Adjacent suffixes are compared over LENGTH bytes.
3. Anchors with over HOT different contexts (a common phrase) are split: their windows are dealt anew by what SPAN
   neighbouring windows have in common, and those whose common bytes stand elsewhere too are grouped by digest.

Null and empty texts have no bytes, and texts under LENGTH bytes lose none. Repeated rows are documents of their own and
so remove each other; rows are told apart by id and text hash. Very long texts are read in stretches of BLOCK bytes that
overlap. Equal contexts are ties, and any of them stands for all. An empty table gives no rows; columns other than the id
and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

LENGTH, GRAM, HOT, SPAN = 200, 64, 256, 16
BLOCK, GATHER = 1 << 19, 1 << 19
VALUE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_B, _MIX = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` (a power of two) bytes from each place on."""
    h, m, b = VALUE[data], 1, _B
    while m < size:
        h = h[:-m] * np.uint64(b) + h[m:]
        m, b = 2 * m, b * b & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        a = np.minimum(a[:-m], a[m:])
        m *= 2
    return np.minimum(a[: len(a) - (width - m)], a[width - m :]) if width > m else a


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of the texts: (text, first window's start, windows, anchor's hash, its distance from the start).

    At most 2**24 bytes together.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, np.empty(0, np.uint64), none
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 24) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = (least & low).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    end = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + length <= end[doc]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    start = np.nonzero(first)[0]
    run = np.cumsum(first)[valid] - 1
    return doc[start], start - (end - sizes)[doc[start]], np.bincount(run, minlength=len(start)), h[at[start]], at[start] - start


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    top = int(s.max()) + 1
    if top > 1 << 20:
        s = np.unique(s, return_inverse=True)[1] + 1
        top = int(s.max()) + 1
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    extra = n % 3 == 1  # a sampled triple of zeros closes the first half
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    pair = t[:-1] * top + t[1:]
    triple = np.unique(pair, return_inverse=True)[1].astype(np.int64)[sample] * top + t[sample + 2]
    known, names = np.unique(triple, return_inverse=True)
    order = np.argsort(names, kind="stable") if len(known) == len(sample) else suffix_array(names.astype(np.int64) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    wide = n + 4
    key0 = t[zero] * wide + rank[zero + 1]
    by = np.argsort(key0, kind="stable")
    zero, key0 = zero[by], key0[by]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    less = np.searchsorted(t[ones] * wide + rank[ones + 1], key0)
    pairs = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    less = less + np.searchsorted(pairs[twos] * wide + rank[twos + 2], pairs[zero] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + less
    rest = np.ones(n, bool)
    rest[place] = False
    out[place], out[rest] = zero, sorted12
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different contexts, which of its windows stand elsewhere among them too."""
    raw = b"\0".join([*contexts, b""])
    data = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
    sizes = np.array([len(c) for c in contexts])
    start = np.cumsum(sizes + 1) - sizes - 1
    data[start + sizes] = 1
    order = suffix_array(data)
    end = np.repeat(start + sizes, sizes + 1)
    fits = np.arange(len(data)) + length <= end
    a, b = order[:-1], order[1:]
    # Eight bytes at a time: words that begin at each place.
    word = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.uint64)
    for m in (1, 2, 4):
        word = word[:-m] | (word[m:] << np.uint64(8 * m))
    live = np.nonzero(fits[a] & fits[b])[0]
    for k in [*range(0, length - 7, 8), length - 8]:
        live = live[word[a[live] + k] == word[b[live] + k]]
    hit = np.zeros(len(data), bool)
    hit[a[live]] = hit[b[live]] = True
    return [hit[x : x + max(0, n - length + 1)] for x, n in zip(start.tolist(), sizes.tolist())]


def intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(a, b - 1) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]


ANCHORS = "name long, ctx long, id long, th int, s int, n int, rel int"
SPANS = "name long, ctx long, spans array<struct<lo:int,hi:int>>"
_SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _anchor_rows(batches, length: int):
    def out(held):
        doc, start, n, name, rel = anchors([t for _, _, t, _ in held], length)
        views = [memoryview(t) for _, _, t, _ in held]
        ctx = [xxhash.xxh3_64_intdigest(views[d][s : s + k + length - 1]) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist())]
        ids, ths, offs = (np.array([h[c] for h in held], np.int64)[doc] if len(held) else doc for c in (0, 1, 3))
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(ids), pa.array(ths.astype(np.int32)), pa.array((start + offs).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(rel.astype(np.int32))], names=["name", "ctx", "id", "th", "s", "n", "rel"])

    for b in batches:
        held, size = [], 0
        for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            t = t.as_py() or b""
            for at in range(0, max(1, len(t) - length + 1), BLOCK):  # long texts in stretches that share length - 1 bytes
                part = t[at : at + BLOCK + length - 1] if len(t) > BLOCK else t
                if len(part) >= length:
                    if size + len(part) > 2 * BLOCK:
                        yield out(held)
                        held, size = [], 0
                    held.append((i, th, part, at))
                    size += len(part)
        if held:
            yield out(held)


def _slices(batches, length: int):
    for b in batches:
        for k in range(b.num_rows):
            t, rows = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([r["name"] for r in rows], pa.int64()), pa.array([r["ctx"] for r in rows], pa.int64()), pa.array([t[r["s"] : r["s"] + r["n"] + length - 1] for r in rows], pa.binary()), pa.array([r["rel"] for r in rows], pa.int32())], names=["name", "ctx", "bytes", "rel"])


def _sorted(batches, length: int):
    """Rows come in order of name; a gathering ends with a name."""

    def out(held):
        keys = list(held)
        found = [(k, intervals(h)) for k, h in zip(keys, repeated_windows([held[k] for k in keys], length)) if h.any()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([[{"lo": a, "hi": z} for a, z in s] for _, s in found], _SPAN)], names=["name", "ctx", "spans"])

    held, size, last = {}, 0, None
    for b in batches:
        for name, ctx, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if name != last and size > GATHER:
                yield out(held)
                held, size = {}, 0
            last = name
            if (name, ctx) not in held:
                held[name, ctx] = raw
                size += len(raw)
    if held:
        yield out(held)


def spans_of(n: int, rel: int) -> dict[int, tuple[int, int]]:
    """The windows 0..n-1 of a context in spans of SPAN, by distance from the anchor: span -> (first, last) window."""
    out: dict[int, tuple[int, int]] = {}
    for k in range(n):
        j = (rel - k) // SPAN
        out[j] = (out.get(j, (k, k))[0], k)
    return out


def _cores(batches, length: int):
    """For each span: digests of the bytes that its windows have in common (they lie in each), and of all its bytes."""
    for b in batches:
        rows = []
        for name, ctx, raw, rel in zip(*(b.column(c).to_pylist() for c in range(4))):
            view = memoryview(raw)
            for j, (lo, hi) in spans_of(len(raw) - length + 1, rel).items():
                first = rel - j * SPAN  # the window nearest to the anchor starts here, if it is there
                core, whole = view[max(0, first) : max(0, first - SPAN + 1 + length)], view[lo : hi + length]
                rows.append((name, ctx, j, lo, hi, xxhash.xxh3_64_intdigest(core) - (1 << 63), xxhash.xxh3_64_intdigest(whole, lo - rel + (1 << 32)) - (1 << 63)))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["name", "ctx", "j", "lo", "hi", "d", "w"])


def _windows(batches, length: int):
    for b in batches:
        for name, ctx, raw, rel, js in zip(*(b.column(c).to_pylist() for c in range(5))):
            view, own = memoryview(raw), spans_of(len(raw) - length + 1, rel)
            ks = [k for j in js for k in range(own[j][0], own[j][1] + 1)]
            d = np.array([xxhash.xxh3_64_intdigest(view[k : k + length]) for k in ks], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ks), pa.int64()), pa.array([ctx] * len(ks), pa.int64()), pa.array(ks, pa.int32()), pa.array(d.view(np.int64))], names=["name", "ctx", "k", "d"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, text, n_bytes, n_removed, n_spans, kept_sha256); text holds the bytes that are left."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("th"), text.cast("binary").alias("t"))
    found = rows.mapInArrow(lambda b: _anchor_rows(b, length), ANCHORS)
    twice = found.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name")
    hits = checkpoint(found.join(twice, "name"))
    contexts = checkpoint(hits.groupBy("name", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "s", "n", "rel")).alias("r")))
    several = contexts.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    work = contexts.join(several, "name").select("name", "ctx", "r.*")
    wanted = work.groupBy("id", "th").agg(F.collect_list(F.struct("name", "ctx", "s", "n", "rel")).alias("rows"))
    cut = checkpoint(rows.join(wanted, ["id", "th"]).select("t", "rows").mapInArrow(lambda b: _slices(b, length), "name long, ctx long, bytes binary, rel int").join(several, "name").select("name", "ctx", "bytes", "rel", (F.col("kinds") > HOT).alias("hot")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut.where("NOT hot").select("name", "ctx", "bytes").repartition(parts, "name").sortWithinPartitions("name", "ctx").mapInArrow(lambda b: _sorted(b, length), SPANS)
    hot = cut.where("hot").select("name", "ctx", "bytes", "rel").dropDuplicates(["name", "ctx"])
    cores = checkpoint(hot.mapInArrow(lambda b: _cores(b, length), "name long, ctx long, j int, lo int, hi int, d long, w long"))
    kinds = cores.groupBy("name", "j", "w").agg(F.count("*").alias("c"), F.min("ctx").alias("ctx"), F.min("d").alias("d"))
    # Spans that are equal as a whole are settled at once; one of each kind is compared with the other kinds of its core.
    whole = cores.join(kinds.where("c > 1").select("name", "j", "w"), ["name", "j", "w"]).groupBy("name", "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    common = kinds.groupBy("name", "j", "d").agg(F.count("*").alias("n")).where("n > 1").select("name", "j", "d")
    kept = kinds.join(common, ["name", "j", "d"]).groupBy("name", "ctx").agg(F.collect_set("j").alias("js"))
    windows = hot.join(kept, ["name", "ctx"]).select("name", "ctx", "bytes", "rel", "js").mapInArrow(lambda b: _windows(b, length), "name long, ctx long, k int, d long")
    again = windows.groupBy("name", "d").agg(F.count("*").alias("c")).where("c > 1").select("name", "d")
    split = windows.join(again, ["name", "d"]).groupBy("name", "ctx").agg(F.transform(F.collect_set("k"), lambda k: F.struct(k.alias("lo"), k.alias("hi"))).alias("spans"))
    copies = contexts.where("c > 1").select("name", "ctx", F.array(F.struct(F.lit(0).alias("lo"), (F.col("r.n") - 1).alias("hi"))).alias("spans"))
    others = sorted_.unionByName(split).unionByName(whole).join(contexts.where("c = 1").select("name", "ctx"), ["name", "ctx"])
    spans = checkpoint(copies.unionByName(others))
    covered = hits.join(spans, ["name", "ctx"]).select("id", "th", F.transform("spans", lambda x: F.struct((F.col("s") + x["lo"]).alias("a"), (F.col("s") + x["hi"] + length).alias("b"))).alias("spans"))
    gone = covered.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches):
        for b in batches:
            kept, n, lost, count, sha = [], [], [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                t, cut_ = t.as_py() or b"", merged([(x["a"], x["b"]) for x in s.as_py() or ()])
                last, left = 0, []
                for a, z in cut_:
                    left.append(t[last:a])
                    last = z
                left = b"".join([*left, t[last:]])
                kept.append(left)
                n.append(len(t))
                lost.append(len(t) - len(left))
                count.append(len(cut_))
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, lost, count)), pa.array(sha)], names=["id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = rows.join(gone, ["id", "th"], "left").select("id", "t", "spans").mapInArrow(finish, "id long, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
