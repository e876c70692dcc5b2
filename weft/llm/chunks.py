"""Substring dedup by content-defined chunking.

A gear rolling hash over the 16 bytes before a place ranks the places where a text may be cut; a place of the least rank
in any stretch of WINDOW places is a cut. So equal passages are cut alike wherever they stand, an insertion moves only
the cuts near it, and every passage of 2 * WINDOW bytes holds a whole chunk. Words begin at a place after white space or
at a character of three bytes or more (scripts without spaces); other characters are cut only where no word begins.

1. Chunks are grouped by digest; of equal chunks the first, by document id and place, stays.
2. Stretches of further copies that can hold `least` words name the place they copy, and ask for its bytes.
3. The bytes come back, a page at a time, and are compared one by one with the document's own, chunk borders or not. What
   equals an earlier place, in whole words, goes if it has at least `least` words or `least_bytes` bytes. Digests only
   find candidates, so nothing goes that doesn't stand elsewhere too.

Null texts have no chunks and stay null; empty texts stay empty. Rows that repeat an id and its text count as one
document and get the same result; other repeated ids are told apart by a hash of the text. Ties between equal chunks go
to the smaller id, text hash and place. Very long texts are chunked whole and asked for by pages of PAGE bytes. An empty
table gives no rows. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import fresh, trim

GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
GEAR[0] = 0
PAD, WINDOW, CLOSE, PAGE = b"\0" * 16, 96, 16, 4096
#: How far beyond a chunk, at least, the passage around it is looked at; from there on there is another whole chunk.
REACH = 2 * WINDOW
LEAST_WORDS, LEAST_BYTES = 50, 600


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over a[p : p + width] for each p, by doubling."""
    m = 1
    while 2 * m <= width:
        a = op(a[:-m], a[m:])
        m *= 2
    return op(a[: len(a) - (width - m)], a[width - m :]) if width > m else a


def _begins(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and which bytes are white space."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begin = data >= 0xE0
    begin[1:] |= blank[:-1] & ~blank[1:]
    return begin, blank


def cuts(texts: list[bytes], window: int = WINDOW) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ends of each text's chunks, and how many words begin before each place of it."""
    data = np.frombuffer(PAD.join([b"", *texts, b""]), np.uint8)
    h = GEAR[data]
    for m in (1, 2, 4, 8):
        h[m:] = h[m:] + (h[:-m] << np.uint32(m))
    begin, _ = _begins(data)
    rank = np.empty(len(data), np.uint32)
    rank[0], rank[1:] = 0, h[:-1] >> np.uint32(1)
    rank[~begin] |= np.uint32(1 << 31)
    rank[(data & 0xC0) == 0x80] = 0xFFFFFFFF
    sizes = np.array([len(t) for t in texts], np.int64)
    start = len(PAD) + np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    found = np.empty(0, np.int64)
    if len(data) > window:
        low = _slide(rank, window, np.minimum)
        edge = np.zeros(len(low) + 1, np.int8)  # windows that lie within a text, behind its first place
        whole = sizes > window
        np.add.at(edge, start[whole] + 1, 1)
        np.add.at(edge, start[whole] + sizes[whole] - window + 1, -1)
        low[np.cumsum(edge[:-1]) == 0] = 0
        rim = np.zeros(window - 1, np.uint32)
        high = _slide(np.concatenate([rim, low, rim]), window, np.maximum)
        found = np.nonzero((rank <= high) & (high > 0))[0]
        found = found[_apart(found, rank[found])]
    words = np.concatenate([[0], np.cumsum(begin)])
    at = np.searchsorted(found, np.append(start, len(data)))
    ends = [np.append(found[at[k] : at[k + 1]] - start[k], len(t)) if t else np.empty(0, np.int64) for k, t in enumerate(texts)]
    return ends, [words[s : s + n + 1] - words[s] for s, n in zip(start.tolist(), sizes.tolist())]


def _apart(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which cuts stay: one within CLOSE bytes of a cut of less rank goes; of equal ranks, as periodic texts have one a
    period, those within CLOSE bytes of the last one that stays."""
    near = np.diff(found) < CLOSE
    keep = np.ones(len(found), bool)
    keep[1:] &= ~(near & (rank[:-1] < rank[1:]))
    keep[:-1] &= ~(near & (rank[1:] < rank[:-1]))
    at = np.flatnonzero(keep)
    last = -1
    for k in (np.flatnonzero(np.diff(found[at]) < CLOSE) + 1).tolist():
        if keep[at[k - 1]]:
            last = found[at[k - 1]]
        keep[at[k]] = found[at[k]] - last >= CLOSE
    return keep


FOUND = "digest long, id long, th int, at int"


def _rows(batches, sizes: bool):
    """Chunks; with sizes also each one's length, and the words in it and in reach on either side (10 bits each)."""
    trim()
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
            ends, words = cuts(texts)
            digest, n = [], [len(e) for e in ends]
            for t, e in zip(texts, ends):
                view, last = memoryview(t), 0
                for x in e.tolist():
                    digest.append(xxhash.xxh3_64_intdigest(view[last:x]))
                    last = x
            rep = np.repeat(np.arange(len(texts)), n)
            starts = [np.concatenate([[0], e[:-1]]) if len(e) else e for e in ends]
            end, start = np.concatenate([np.empty(0, np.int64), *ends]), np.concatenate([np.empty(0, np.int64), *starts])
            cols = [pa.array(np.array(digest, np.uint64).view(np.int64)), part.column(0).take(pa.array(rep)), part.column(1).take(pa.array(rep)), pa.array(start.astype(np.int32))]
            names = ["digest", "id", "th", "at"]
            if sizes:
                near = []
                for s, e, w in zip(starts, ends, words):
                    before, after = w[s] - w[np.maximum(s - REACH, 0)], w[np.minimum(e + REACH, len(w) - 1)] - w[e] if len(e) else e
                    near.append(before | (w[e] - w[s]) << 10 | after << 20)
                cols += [pa.array((end - start).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *near]).astype(np.int32))]
                names += ["size", "near"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


ASKED = "sid long, sth int, page int, lo int, hi int, id long, th int, g int, at int"


def asked(own: tuple[int, int], chunks: list[tuple], least: int, least_bytes: int) -> list[tuple]:
    """(source id, source text hash, page, lo, hi, g, at) for the copied chunks (at, size, near, source id, hash, place) of
    the document `own` (id, hash): bytes lo to hi of the source should equal those from `at` on. Rows of one g have one
    source and shift. A chunk that comes again within a document copies its own last one, so periodic runs have one shift."""
    out, run, g, last = [], [], 0, {}
    chunks = sorted(chunks)
    for k, (at, size, near, *source) in enumerate(chunks):
        if tuple(source) in last:
            chunks[k] = (at, size, near, *own, last[tuple(source)])
        last[tuple(source)] = at
    for k, c in enumerate(chunks):
        run.append(c)
        if k + 1 < len(chunks) and chunks[k + 1][0] == c[0] + c[1]:
            continue
        words = (run[0][2] & 1023) + (run[-1][2] >> 20) + sum(x[2] >> 10 & 1023 for x in run) + 2
        if words >= least or run[-1][0] + run[-1][1] - run[0][0] + 2 * REACH >= least_bytes:
            sources: dict = {}
            for at, size, _, sid, sth, place in run:
                spans = sources.setdefault((sid, sth, place - at), [])
                if spans and at - spans[-1][1] <= 2 * REACH:
                    spans[-1][1] = at + size
                else:
                    spans.append([at, at + size])
            for (sid, sth, shift), spans in sources.items():
                for a, z in spans:
                    a, z, g = max(a - REACH + shift, 0, shift), z + REACH + shift, g + 1
                    out += [(sid, sth, p, max(a, p * PAGE), min(z, p * PAGE + PAGE), g, max(a, p * PAGE) - shift) for p in range(a // PAGE, (z - 1) // PAGE + 1)]
        run = []
    return out


def equal_runs(text: bytes, pieces: list[tuple], least: int, least_bytes: int) -> list[tuple[int, int]]:
    """What goes from a text, as sorted spans: pieces are (g, at, bytes of an earlier place)."""
    data, out, k = np.frombuffer(text, np.uint8), [], 0
    pieces = sorted(set(pieces))
    begin = None
    while k < len(pieces):
        g, at, raw = pieces[k]
        k += 1
        parts = [raw]
        while k < len(pieces) and pieces[k][0] == g and pieces[k][1] == at + sum(map(len, parts)):
            parts.append(pieces[k][2])
            k += 1
        other = np.frombuffer(b"".join(parts), np.uint8)[: len(data) - at]
        same = np.zeros(len(other) + 2, np.int8)
        same[1:-1] = data[at : at + len(other)] == other
        edge = np.flatnonzero(np.diff(same))
        for a, z in zip((edge[0::2] + at).tolist(), (edge[1::2] + at).tolist()):
            if z - a < 2 * least - 1 and z - a < least_bytes:
                continue
            if begin is None:  # words begin here, and end there
                begin, blank = _begins(data)
                begin[0] = not blank[0]
                stop = np.concatenate([[False], (begin[1:] | blank[1:]) & ~blank[:-1], ~blank[-1:]])
                begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
            first, last = np.searchsorted(begin, a), np.searchsorted(stop, z, side="right") - 1
            if first == len(begin) or last < 0 or stop[last] <= begin[first]:
                continue
            a, z = int(begin[first]), int(stop[last])
            if np.searchsorted(begin, z) - first >= least or z - a >= least_bytes:
                out.append((a, z))
    merged: list[list[int]] = []
    for a, z in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    return [(a, z) for a, z in merged]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("th"), text.alias("t"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, th, pieces array<struct<g, at, raw>>): earlier bytes that documents may repeat, for documents that have some."""
    rows = _keyed(docs, id_col, text_col)
    place = F.struct("id", "th", "at")
    first = rows.mapInArrow(lambda b: _rows(b, False), FOUND).groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first")
    every = rows.mapInArrow(lambda b: _rows(b, True), f"{FOUND}, size int, near int")
    again = every.join(first, "digest").where(~place.eqNullSafe(F.col("first")))
    found = again.groupBy("id", "th").agg(F.collect_list(F.struct("at", "size", "near", F.col("first.id").alias("sid"), F.col("first.th").alias("sth"), F.col("first.at").alias("place"))).alias("chunks"))

    def ask(batches):
        for b in batches:
            out = []
            for i, th, chunks in zip(*(b.column(c).to_pylist() for c in range(3))):
                found = asked((i, th), [tuple(c.values()) for c in chunks], least, least_bytes)
                out += [(*r[:5], i, th, *r[5:]) for r in found]
            cols = list(zip(*out)) or [()] * 9
            types = (pa.int64(), *(pa.int32(),) * 4, pa.int64(), *(pa.int32(),) * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["sid", "sth", "page", "lo", "hi", "id", "th", "g", "at"])

    def pages(batches):
        codec = pa.Codec("zstd", 1)
        for b in batches:
            for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                t = t.as_py() or b""
                parts = [t[s : s + PAGE] for s in range(0, len(t), PAGE)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([th] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(map(len, parts), pa.int32()), pa.array([codec.compress(p, asbytes=True) for p in parts], pa.binary())], names=["sid", "sth", "page", "size", "z"])

    def answer(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            raw = [codec.decompress(z, n, asbytes=True)[lo - p * PAGE : hi - p * PAGE] for z, n, p, lo, hi in zip(*(b.column(c).to_pylist() for c in ("z", "size", "page", "lo", "hi")))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "th", "g", "at")] + [pa.array(raw, pa.binary())], names=["id", "th", "g", "at", "raw"])

    # A page is asked for as often as its chunks have copies: the join may be split by AQE where that is often.
    held = rows.where("t IS NOT NULL").mapInArrow(pages, "sid long, sth int, page int, size int, z binary")
    answers = found.mapInArrow(ask, ASKED).join(held, ["sid", "sth", "page"]).mapInArrow(answer, "id long, th int, g int, at int, raw binary")
    return answers.groupBy("id", "th").agg(F.collect_list(F.struct("g", "at", "raw")).alias("pieces"))


def _spans(text: bytes, pieces, least: int, least_bytes: int) -> list[tuple[int, int]]:
    found = pieces.as_py()
    return equal_runs(text, [(p["g"], p["at"], p["raw"]) for p in found], least, least_bytes) if found else []


def _cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, last = [], 0
    for a, b in gone:
        kept.append(text[last:a])
        last = b
    return b"".join([*kept, text[last:]])


def _packed(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts as (compressed bytes, length), so that shuffles move less; nulls stay."""
    codec = pa.Codec("zstd", 1)
    raw = texts.cast(pa.binary()).to_pylist()
    return pa.array([None if t is None else codec.compress(t, asbytes=True) for t in raw], pa.binary()), pa.array([None if t is None else len(t) for t in raw], pa.int64())


def _unpacked(z: pa.Array, n: pa.Array):
    codec = pa.Codec("zstd")
    for a, k in zip(z, n.to_pylist()):
        yield None if k is None else codec.decompress(a.as_buffer(), k, asbytes=True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id_col, text, n_bytes, n_removed, n_spans, kept_sha256): what is left of each row's text."""
    found = repeats(docs, id_col, text_col, least, least_bytes)

    def shrink(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_packed(b.column(2))], names=["id", "th", "z", "n"])

    joined = _keyed(docs, id_col, text_col).mapInArrow(shrink, "id long, th int, z binary, n long").join(found, ["id", "th"], "left").select("id", "z", "n", "pieces")

    def run(batches):
        for b in batches:
            kept, n, lost, runs, sha = [], [], [], [], []
            for t, p in zip(_unpacked(b.column(1), b.column(2)), b.column(3)):
                gone = _spans(t or b"", p, least, least_bytes)
                left = None if t is None else _cut(t, gone)
                kept.append(None if left is None else left.decode())
                n.append(len(t or b""))
                lost.append(sum(e - a for a, e in gone))
                runs.append(len(gone))
                sha.append(hashlib.sha256(left or b"").hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (n, lost, runs)), pa.array(sha)], names=["id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", least: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The same rows and columns with the repeats cut out of the text; chars_col, if there, counts what is left."""
    names, k = docs.columns, len(docs.columns)
    own = fresh(names, "id", "th", "z", "n", "pieces")
    found = repeats(docs, id_col, text_col, least, least_bytes).toDF(own[0], own[1], own[4])
    text = F.col(text_col).cast("string")
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else -1
    rows = docs.select(F.col(id_col).cast("long").alias(own[0]), F.hash(text).alias(own[1]), *[F.col(c) if c != text_col else text.alias(c) for c in names])

    def shrink(batches):
        for b in batches:
            z, n = _packed(b.column(2 + at))
            cols = [*b.columns, z, n]
            cols[2 + at] = pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, own[2], own[3]])

    small = rows.mapInArrow(shrink, StructType([*rows.schema.fields, StructField(own[2], BinaryType()), StructField(own[3], LongType())]))
    joined = small.join(found, [own[0], own[1]], "left").select(*names, *own[2:])

    def run(batches):
        for b in batches:
            texts = []
            for t, p in zip(_unpacked(b.column(k), b.column(k + 1)), b.column(k + 2)):
                texts.append(None if t is None else _cut(t, _spans(t, p, least, least_bytes)).decode())
            cols = list(b.columns[:k])
            cols[at] = pa.array(texts, pa.string())
            if chars >= 0:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.select(*[F.col(c) if c != text_col else text.alias(c) for c in names]).schema)
