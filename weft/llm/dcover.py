"""The suffix sort of a whole corpus by the difference cover modulo 3, each step a sort or join of distributed tables.

1. Triples of the sampled places (1 and 2 modulo 3) are sorted and named by their place among the distinct ones.
2. Unless all names differ, the sequence of names is sorted by recursion, which ranks the sampled suffixes.
3. The remaining suffixes are merged in: places 0 and 1 modulo 3 share the key (symbol, rank of the next place), places 0
   and 2 the key (symbol, symbol, rank of the place after). Two sorts by these keys and the sampled ranks tell of each
   suffix how many of either other class are smaller, so no comparison of unlike keys is needed.
4. Adjacent suffixes are compared over LENGTH bytes.

A global sort is a range partitioning and a rank within each part; only the parts' totals are gathered. It moves several
times the corpus for each level, see the README for figures; op3_suffix_dedup uses suffix.remove_repeats.

Symbols are 1 and above; places run from 0 without gaps. An empty table has no ranks. Very long texts are stretches of
places like any other, ties do not occur (suffixes differ in length), and columns beside those named are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .suffix import LENGTH, suffix_array

SMALL = 1 << 16


def ordered(df: DataFrame, keys: list[str], flags: dict[str, object]) -> DataFrame:
    """Adds to each row, for each flag, how many rows before it in the order of the keys have it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = checkpoint(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    flag = {n: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in flags.items()}
    total = x.groupBy("_part").agg(*[F.sum(c).alias(f"_t{n}") for n, c in flag.items()])
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("_part", *[F.coalesce(F.sum(f"_t{n}").over(up), F.lit(0)).alias(f"_b{n}") for n in flag])  # one row a part
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumns({f"_i{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in flag.items()}).join(F.broadcast(base), "_part")
    return y.select(*df.columns, *[(F.col(f"_i{n}") + F.col(f"_b{n}")).alias(n) for n in flag])


def shifted(s: DataFrame, by: dict[str, int], keep) -> DataFrame:
    """(pos, names): for each kept place the values at pos + shift, 0 beyond the end; one aggregation by place."""
    rows = None
    for name, k in by.items():
        one = s.select((F.col("pos") - k).alias("pos"), *[(F.col("c") if n == name else F.lit(None).cast("long")).alias(n) for n in by]).where("pos >= 0").where(keep)
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("pos").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in by])


def ranks(s: DataFrame, n: int, small: int = SMALL) -> DataFrame:
    """(pos, rank from 1) of the suffixes of the n symbols s(pos, c)."""
    if n <= small:  # one task of bounded size
        def run(frames):
            f = pd.concat([pd.DataFrame({"pos": [], "c": []}, dtype=np.int64), *frames]).sort_values("pos")
            order = suffix_array(f["c"].to_numpy().astype(np.int64))
            yield pd.DataFrame({"pos": order, "rank": np.arange(1, len(order) + 1)})

        return checkpoint(s.select("pos", "c").repartition(1).mapInPandas(run, "pos long, rank long"))
    mod = F.col("pos") % 3
    extra = int(n % 3 == 1)  # a sampled triple of zeros closes the first half
    if extra:
        s = s.unionByName(s.sparkSession.createDataFrame([(n, 0)], "pos long, c long"))
    t = checkpoint(shifted(s, {"a": 0, "b": 1, "d": 2}, mod != 0))
    kinds = ordered(t.select("a", "b", "d").distinct(), ["a", "b", "d"], {"name": F.lit(1)})
    named = checkpoint(t.join(kinds, ["a", "b", "d"]).select("pos", (F.col("name") + 1).alias("c")))
    size, different = named.agg(F.count("*"), F.countDistinct("c")).first()
    half = (n + extra + 1) // 3
    if size != different:
        sub = ranks(named.select((F.when(mod == 1, 0).otherwise(half) + F.floor(F.col("pos") / 3)).cast("long").alias("pos"), "c"), size, small)
        back = F.when(F.col("pos") < half, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - half) + 2)
        named = checkpoint(sub.select(back.alias("pos"), F.col("rank").alias("c")))
    # one row a place: its class, two symbols, and the ranks of it, of the next place and of the one after
    every = shifted(s.where(F.col("pos") < n), {"a": 0, "b": 1}, F.lit(True)).join(shifted(named, {"r0": 0, "r1": 1, "r2": 2}, F.lit(True)), "pos", "left").where(F.col("pos") < n).na.fill(0)
    every = checkpoint(every.withColumn("k", mod))
    k = F.col("k")
    one = ordered(every.where("k <> 2").select("pos", "k", "a", "r1"), ["a", "r1"], {"z": k == 0, "o": k == 1})
    two = ordered(every.where("k <> 1").select("pos", "k", "a", "b", "r2"), ["a", "b", "r2"], {"z": k == 0, "t": k == 2})
    both = ordered(every.where("k <> 0").select("pos", "k", "r0"), ["r0"], {"o": k == 1, "t": k == 2})
    zero = one.where("k = 0").select("pos", "z", "o").join(two.where("k = 0").select("pos", "t"), "pos")
    ones = one.where("k = 1").select("pos", "z").join(both.where("k = 1").select("pos", "o", "t"), "pos")
    twos = two.where("k = 2").select("pos", "z").join(both.where("k = 2").select("pos", "o", "t"), "pos")
    rows = zero.select("pos", "z", "o", "t").unionByName(ones.select("pos", "z", "o", "t")).unionByName(twos.select("pos", "z", "o", "t"))
    return checkpoint(rows.select("pos", (F.col("z") + F.col("o") + F.col("t") + 1).alias("rank")))


def symbols(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, int]:
    """((id, at, pos, c, digest) of each byte and one end symbol a row, their number): c is the byte + 2, 1 at the end;
    digest is that of the `length` bytes from there, null where fewer are left."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    size = F.octet_length("t") + 1
    total = rows.groupBy("part").agg(F.sum(size).alias("n"))
    base = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    start = F.sum(size).over(Window.partitionBy("part").orderBy("row")) - size
    placed = rows.withColumn("start", start).join(F.broadcast(base), "part").select("id", "t", (F.col("start") + F.col("base")).alias("start"))

    def run(batches):
        for b in batches:
            for i, t, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n, view = len(t), memoryview(t)
                c = np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 2, 1)
                d = [xxhash.xxh3_64_intdigest(view[k : k + length]) - (1 << 63) for k in range(max(0, n - length + 1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, i if i is not None else -1)), pa.array(np.arange(n + 1)), pa.array(np.arange(n + 1) + first), pa.array(c), pa.array(d + [None] * (n + 1 - len(d)), pa.int64())], names=["id", "at", "pos", "c", "digest"])

    out = checkpoint(placed.mapInArrow(run, "id long, at long, pos long, c long, digest long"))
    return out, out.count()


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, small: int = SMALL) -> DataFrame:
    """(id, at): where strings of `length` bytes start that start elsewhere too."""
    s, n = symbols(docs, id_col, text_col, length)
    order = ranks(s.select("pos", "c"), n, small)
    full = s.where("digest IS NOT NULL").join(order, "pos").select("id", "at", "rank", "digest")
    # suffixes that share `length` bytes are neighbours, but for shorter ones, which cannot stand between them
    near = full.select("rank", "digest").withColumn("rank", F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1))).withColumnRenamed("digest", "other")
    return full.join(near, "rank").where(F.col("digest") == F.col("other")).select("id", "at").distinct()
