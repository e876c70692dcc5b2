"""Packing by cutting-stock column generation.

Documents are cut only at multiples of the sequence length; full pieces are sequences, and the rest are cutting stock.
A length histogram (at most `grid` classes, so it is small whatever the corpus) goes to the driver, where a linear
program over patterns is solved: a revised simplex holds the basis, a knapsack dynamic programme prices new patterns,
and the rounded-down pattern counts, with a first-fit of the few lengths that rounding left, become sequences. Each
piece gets its rank within its length class, without a global sort, and the rank picks the sequence.

Null and empty texts are one end id. Repeated rows are packed each for itself; an empty table gives no rows; columns
other than the id and the text are not read, whatever their names. Very long texts are encoded whole and give one piece
for each `length` ids. Ranks are ordered by every column of a piece, so ties are equal pieces, and a task that runs again
seats its pieces as before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, trim
from .tokens import Encoder


def pieces(docs: DataFrame, path: str, words: bool, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): one row for each run of at most `length` ids of a document."""

    def run(batches):
        trim()
        enc, end = Encoder.of(path, words), np.array([end_id], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist())):
                    raw = np.concatenate([ids, end]).astype("<u4").tobytes()
                    n = len(raw) // 4
                    rows += [(doc, s, min(length, n - s), zlib.crc32(raw[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(size: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items that fits: its value and the count of each item."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(size, kind="stable")
    size, value = size[order], value[order]
    fits = np.searchsorted(size, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if fits[w]:
            got = best[w - size[: fits[w]]] + value[: fits[w]]
            k = int(got.argmax())
            if got[k] > best[w] + 1e-12:
                best[w], last[w] = got[k], k
    count, w = np.zeros(len(size), int), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            count[last[w]] += 1
            w -= int(size[last[w]])
    out = np.zeros(len(size), int)
    out[order] = count
    return float(best[room]), out


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots. The threaded LAPACK routine can wait for ever in a driver that has forked."""
    m = len(a)
    work = np.concatenate([a, np.eye(m)], axis=1)
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0.0
        work -= np.outer(factor, work[k])
    return work[:, m:]


def cutting_stock(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to cut each, meeting demand; the linear program is solved to within `gap` of its bound.

    Prices are smoothed towards the best dual point so far (Wentges, 1997), which begins at each length's share of the
    room, so that degenerate bases don't make them swing. Farley's bound of each pricing round tells when to stop.
    """
    m = len(size)
    if not m:
        return []
    # A fixed small perturbation, well below one piece, keeps degenerate bases from cycling.
    exact, demand = demand, demand + np.random.default_rng(0).uniform(0.01, 0.05, m)
    basis = np.diag(room // size).astype(float)
    inverse, x = np.diag(1.0 / (room // size)), demand / (room // size)
    centre, bound = size / room, float(size @ demand) / room
    for step in range(most):
        if x.sum() - bound <= gap * bound + 0.5:
            break
        raw = inverse.sum(axis=0)
        dual = np.maximum(raw, 0.0)
        for point in (0.8 * centre + 0.2 * dual, dual):
            price, col = knapsack(size, point, room)
            if (low := float(point @ demand) / max(price, 1.0)) > bound:
                centre, bound = point / max(price, 1.0), low
            if raw @ col > 1 + 1e-9:
                break
        else:
            break
        u = inverse @ col
        ratio = np.full(m, np.inf)
        up = u > 1e-9
        ratio[up] = x[up] / u[up]
        r = int(ratio.argmin())
        basis[:, r] = col
        t = max(0.0, x[r] / u[r])
        x = np.maximum(x - t * u, 0.0)
        x[r] = t
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        if step % 500 == 499:
            inverse = inverse_of(basis)
            x = np.maximum(inverse @ demand, 0.0)
    out, left = [], exact.astype(np.int64)
    for k in np.argsort(-x):
        col = basis[:, k].astype(np.int64)
        used = col > 0
        n = min(int(x[k] + 1e-9), int((left[used] // col[used]).min()))
        if n > 0:
            out.append((col, n))
            left -= n * col
    # What rounding left is at most a few pieces a pattern: first fit, longest first.
    open_, order = [], np.argsort(-size, kind="stable")
    for k in order:
        for _ in range(int(left[k])):
            for bin_ in open_:
                if bin_[0] >= size[k]:
                    break
            else:
                bin_ = [room, np.zeros(m, np.int64)]
                open_.append(bin_)
            bin_[0] -= int(size[k])
            bin_[1][k] += 1
    return out + [(b[1], 1) for b in open_]


def pack(parts: DataFrame, length: int = 2048, grid: int = 128) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `length` ids. Classes are length / grid ids wide."""
    unit = -(-length // grid)
    held = checkpoint(parts.withColumn("cls", F.ceil(F.col("length") / unit).cast("int")).withColumn("part", F.spark_partition_id()))
    counts = checkpoint(held.groupBy("cls", "part").agg(F.count("*").alias("n")))
    histogram = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most `grid` rows
    size = np.array(sorted(histogram), int)
    patterns = cutting_stock(size, np.array([histogram[s] for s in size.tolist()], float), length // unit)
    slots, at, base = [], dict.fromkeys(size.tolist(), 0), 0
    for col, n in patterns:
        for k in np.nonzero(col)[0].tolist():
            s = int(size[k])
            slots.append((s, at[s], at[s] + n * int(col[k]), base, int(col[k])))
            at[s] += n * int(col[k])
        base += n
    spark = parts.sparkSession
    places = spark.createDataFrame(slots, "cls int, low long, high long, base long, times long")
    before = counts.select("cls", "part", (F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")).alias("before"))
    ranked = held.withColumn("rn", F.row_number().over(Window.partitionBy("cls", "part").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")))
    ranked = ranked.join(before, ["cls", "part"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    seated = ranked.join(F.broadcast(places), (ranked.cls == places.cls) & (ranked["rank"] >= places.low) & (ranked["rank"] < places.high))
    seated = seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("times"))).cast("long").alias("sequence_id"))
    w = Window.partitionBy("sequence_id").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return seated.withColumn("offset", F.sum("length").over(w) - F.col("length"))
