"""Learns how foreign words are spelt in Latin letters, from labelled pairs of records."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strsim
from ..functions.text import collapse, to_ascii, words


def sounds_alike(foreign: Column, latin: Column) -> Column:
    """0..1: the ratio of the romanised word and the other, repeated letters collapsed."""
    return strsim.ratio(collapse(to_ascii(foreign)), collapse(latin)) / 100.0


def learn(pairs: DataFrame, alike: Callable[[Column, Column], Column] = sounds_alike, least_count: int = 3, least: float = 0.5, last_components: int = 3) -> DataFrame:
    """(src, dst, score): for each foreign word of the b side the a side's word of the best score.

    pairs: a_name, a_addr, b_name, b_addr. A foreign word of an address meets the words of the last components of the
    other address only. score = count(src, dst) / count(src) * (0.5 + alike), kept from `least` on; ties go to the smaller word.
    """
    foreign = lambda c: F.array_distinct(F.filter(words(F.col(c)), lambda w: w.rlike(r"[^\x00-\x7F]")))
    comps = F.split("a_addr", ",")
    tail = F.array_join(F.slice(comps, F.greatest(F.lit(1), F.size(comps) - (last_components - 1)), F.lit(last_components)), " ")
    both = pairs.select(foreign("b_name").alias("f"), F.array_distinct(words(F.col("a_name"))).alias("e")).unionByName(pairs.select(foreign("b_addr").alias("f"), F.array_distinct(words(tail)).alias("e"))).where(F.size("f") > 0)
    count = both.select(F.explode("f").alias("src"), "e")
    total = count.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    pair = count.select("src", F.explode("e").alias("dst")).where(~F.col("dst").rlike(r"^\d+$")).groupBy("src", "dst").agg(F.count("*").alias("c"))
    scored = pair.join(total, "src").withColumn("score", F.round(F.col("c") / F.col("n") * (0.5 + alike(F.col("src"), F.col("dst"))), 9))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return scored.withColumn("_rk", F.row_number().over(w)).where((F.col("_rk") == 1) & (F.col("score") >= least)).select("src", "dst", "score")
