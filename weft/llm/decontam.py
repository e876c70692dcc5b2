"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly.

A window is 13 consecutive item words (a shorter item is one window). Words are ordered by rarity, by counts over all
documents; as containment must be whole, the necessary prefix of a window is its single rarest word. Documents and
windows are joined by that word, in three steps that hold for any size of either table:

1. Word counts of all documents, pre-aggregated, are joined to the items' words, and give each window's prefix.
2. One pass over the documents finds the places of prefix words that stand beside the word they have next to them in some
   window (a positional bound). It looks them up in a bitmap of BITS bits, which is all that is broadcast, so its size
   does not depend on the tables; a place found by chance costs a row, no more.
3. Places and windows are joined by the prefix word. The length bound (the window must fit into the document) and the
   positional bound (the word's place in the window) leave one place for it, and the words there are compared.

Null texts have no words; empty items have no window; repeated items with one id count once in n_items, items without an
id count as hits but are no item; an empty benchmark or table gives zero hits or no rows; repeated rows give one row each,
ties need no order; very long texts are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few, fresh, trim

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # after lower-casing; bytes of UTF-8 above 7F are all word bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
VALUE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE, MIX = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
BITS = 1 << 26


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def windows(item: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[k : k + size]) for k in range(max(1, len(item) - size + 1))]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words, as (lower-cased bytes, start, end, number of words of each text, hash)."""
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[0::2], edge[1::2]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(start, first))
    if not len(start):
        return data, start, end, n, np.empty(0, np.uint64)
    power = np.full(int((end - start).max()), BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    size = end - start
    each = np.cumsum(size) - size
    off = np.arange(int(size.sum())) - np.repeat(each, size)
    return data, start, end, n, _mixed(np.add.reduceat(VALUE[data[inside]] * power[off], each))


def beside(left: np.ndarray, right: np.ndarray, kind: int) -> np.ndarray:
    """Bits of two neighbouring words, the prefix word being the left one (kind 1) or the right one (kind 2)."""
    return _mixed(left * BASE + right * MIX + np.uint64(kind)) % np.uint64(BITS)


def alone(h: np.ndarray) -> np.ndarray:
    return _mixed(h + np.uint64(3)) % np.uint64(BITS)


def _batched(batches, column: int, most: int = 1 << 21):
    """(first row, texts) of stretches of a batch's rows with bounded bytes together, or one row."""
    for b in batches:
        held, size, at = [], 0, 0
        for k, t in enumerate(b.column(column).cast(pa.binary())):
            t = t.as_py() or b""
            if held and size + len(t) > most:
                yield b, at, held
                held, size, at = [], 0, k
            held.append(t)
            size += len(t)
        if held:
            yield b, at, held


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word, by hash, stands in column t."""

    def run(batches):
        for _, _, held in _batched(batches, 0):
            h, n = np.unique(hashed(held)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(bench: DataFrame, counts: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(h, place, length, bit, window, item): each window with its rarest word, the place of that, and its bit."""
    items = checkpoint(bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"), F.monotonically_increasing_id().alias("row")))

    def split(batches):
        for b in batches:
            for i, row, t in zip(b.column(0), b.column(2).to_pylist(), b.column(1).cast(pa.binary())):
                _, _, _, _, h = hashed([t.as_py() or b""])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(h), pa.int64()), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))], names=["row", "k", "h"])

    ranked = items.mapInArrow(split, "row long, k int, h long").join(counts, "h", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("ranks"))

    def run(batches):
        for b in batches:
            out = []
            for item, t, ranks in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                own, rank, h = words(t.as_py()), [(r["n"], r["h"]) for r in ranks], np.array([r["h"] for r in ranks], np.int64).view(np.uint64)
                right, left, one = beside(h[:-1], h[1:], 1), beside(h[:-1], h[1:], 2), alone(h)
                for k, w in enumerate(windows(own, size)):
                    place = min(range(len(w)), key=lambda j: (rank[k + j], j))
                    at = k + place
                    bit = right[at] if place + 1 < len(w) else left[at - 1] if place else one[at]
                    out.append((rank[at][1], place, len(w), int(bit), b" ".join(w), item))
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["h", "place", "length", "bit", "window", "item"])

    return items.join(ranked, "row").select("item", "t", "ranks").mapInArrow(run, "h long, place int, length int, bit long, window binary, item string").distinct()


def _places(docs: DataFrame, bitmap: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """(row, id, th, n, places): of each row its number of words, and the places of prefix words with the words around."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("around", pa.binary())]))

    def run(batches):
        from pyspark import TaskContext

        trim()
        bits = np.zeros(BITS // 64, np.uint64)
        bits[bitmap[0]] = bitmap[1]
        has = lambda x: (bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) > 0
        row = TaskContext.get().partitionId() << 33
        for b, at, held in _batched(batches, 2):
            data, start, end, n, h = hashed(held)
            found = has(alone(h))
            if len(h) > 1:
                found[:-1] |= has(beside(h[:-1], h[1:], 1))
                found[1:] |= has(beside(h[:-1], h[1:], 2))
            last = np.cumsum(n)
            spot = np.flatnonzero(found)
            doc = np.searchsorted(last, spot, side="right")
            out: list[list] = [[] for _ in held]
            for k, d in zip(spot.tolist(), doc.tolist()):
                low = int(last[d] - n[d])
                a, z = max(low, k - size + 1), min(int(last[d]), k + size)
                out[d].append({"h": int(h[k].astype(np.int64)), "pos": k - low, "first": a - low, "around": data[start[a] : end[z - 1]].tobytes()})
            part = b.slice(at, len(held))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(held))), part.column(0), part.column(1), pa.array(n), pa.array(out, kind)], names=["row", "id", "th", "n", "places"])
            row += len(held)

    schema = f"row long, id {docs.schema['id'].dataType.simpleString()}, th long, n long, places array<struct<h:bigint,pos:int,first:int,around:binary>>"
    return docs.mapInArrow(run, schema)


def covered(spans: list[tuple[int, int]], n: int) -> int:
    """How many of n places lie in some (start, length)."""
    step = np.zeros(n + 1, np.int64)
    for start, length in spans:
        step[start] += 1
        step[start + length] -= 1
    return int((np.cumsum(step[:n]) > 0).sum())


def found(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, size: int) -> DataFrame:
    """(row, id, th, n, n_hit, items): of each row of docs. th is a hash of the text, items the sorted ids or null."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    windows_ = checkpoint(prefixes(bench, word_counts(rows.select("t")), item_col, item_text, size))
    # One bit a window and kind of neighbour: at most BITS / 64 rows, however many windows there are.
    cells = windows_.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    bitmap = cells["cell"].to_numpy(), cells["bits"].to_numpy().view(np.uint64)
    seen = checkpoint(_places(rows, bitmap, size))
    places = seen.where(F.size("places") > 0).select("row", "n", F.explode("places").alias("x")).select("row", "n", "x.*")
    keyed = windows_.select("h", "place", "length", "window").distinct()
    start = F.col("pos") - F.col("place")
    pairs = places.join(keyed, "h").where((start >= 0) & (start + F.col("length") <= F.col("n")))

    def verify(batches):
        for b in batches:
            keep = []
            for around, first, pos, place, length, window in zip(*(b.column(c).to_pylist() for c in ("around", "first", "pos", "place", "length", "window"))):
                a = pos - place - first
                keep.append(a >= 0 and b" ".join(WORD.findall(around)[a : a + length]) == window)
            yield b.filter(pa.array(keep, pa.bool_())).select(["row", "n", "pos", "place", "length", "window"])

    hits = checkpoint(pairs.select("row", "n", "around", "first", "pos", "place", "length", "window").mapInArrow(verify, "row long, n long, pos int, place int, length int, window binary").select("row", "n", start.alias("start"), "length", "window"))
    spans = hits.groupBy("row", "n").agg(F.collect_set(F.struct("start", "length")).alias("spans"))

    def cover(batches):
        for b in batches:
            n_hit = [covered([(s["start"], s["length"]) for s in spans], n) for n, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_hit, pa.int64())], names=["row", "n_hit"])

    owned = hits.select("row", "window").distinct().join(windows_.select("window", "item").distinct(), "window")
    items = owned.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_row = spans.mapInArrow(cover, "row long, n_hit long").join(items, "row")
    return seen.drop("places").join(per_row, "row", "left")


def contaminated(percent: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n") * percent)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, percent: int = 5) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated); contaminated: n_hit > 0 and n_hit >= percent of the words."""
    none = hashlib.sha256(b"").hexdigest()
    rows = found(docs, bench, id_col, text_col, item_col, item_text, size).na.fill(0, ["n_hit"])
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        "n_hit",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.when(F.col("items").isNull(), none).otherwise(F.sha2(F.array_join("items", ","), 256)).alias("items_sha256"),
        contaminated(percent).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, percent: int = 5) -> DataFrame:
    """The rows, all columns, that are not contaminated. Rows of one id are told apart by their texts' hashes."""
    own = fresh(docs.columns, "id", "th")
    bad, _ = few(checkpoint(found(docs, bench, id_col, text_col, item_col, item_text, size).where(contaminated(percent)).select(F.col("id").alias(own[0]), F.col("th").alias(own[1])).distinct()))
    same = docs[id_col].eqNullSafe(bad[own[0]]) & (F.xxhash64(docs[text_col].cast("string")) == bad[own[1]])
    return docs.join(bad, same, "left_anti")
