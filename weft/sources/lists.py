"""Tab-separated records and match lists: readers, writers and the validator."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize

RECORD = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """All strings; quotes are text, nothing is null."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", nullValue="\0", encoding="UTF-8").na.fill("")


def read_records(spark: SparkSession, first: str, *pools: str) -> tuple[DataFrame, DataFrame]:
    """Queries and the pooled other sources; src is the id's second character."""
    frames = [read_tsv(spark, p) for p in pools]
    pool = frames[0]
    for f in frames[1:]:
        pool = pool.unionByName(f)
    return read_tsv(spark, first), pool.withColumn("src", F.substring("entity_id", 2, 1).cast("byte"))


def explode_lists(df: DataFrame, col: str = "matched_entity_ids", key: str = "source1_entity_id") -> DataFrame:
    """(q, p) from comma lists; empty ids go."""
    return df.select(F.col(key).alias("q"), F.explode(F.split(F.col(col), ",")).alias("p")).where((F.col("p") != "") & (F.col("q") != ""))


def read_lists(spark: SparkSession, path: str, col: str = "matched_entity_ids") -> DataFrame:
    return explode_lists(read_tsv(spark, path, f"source1_entity_id string, {col} string"), col)


def to_lists(chosen: DataFrame, ids: DataFrame, col: str = "matched_entity_ids") -> DataFrame:
    """One row an id, also without matches: its sorted distinct matches, joined by commas. ids: q."""
    g = chosen.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set(F.col("p").cast("string"))), ",").alias(col))
    return ids.select("q").join(g, "q", "left").select(F.col("q").cast("string").alias("source1_entity_id"), F.coalesce(col, F.lit("")).alias(col))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def text_pair(name: Column, addr: Column, country: Column | None = None) -> Column:
    text = F.concat(F.trim(name), F.lit(" | "), F.trim(addr))
    return text if country is None else F.concat(country, F.lit(": "), text)


def raw_paths(folder: str, split: str) -> dict[str, str]:
    """Where a split's three sources and its truth lie."""
    own = f"{folder.rstrip('/')}/{split}/{split}"
    return {**{f"source{k}": f"{own}_source{k}.tsv" for k in (1, 2, 3)}, "truth": f"{own}_ground_truth.tsv"}


def prepare(spark: SparkSession, folder: str, split: str, out: str, translit: DataFrame | None = None) -> None:
    """Normalise a split's queries and pooled sources, with learnt words if given, and write `out`/{split}_s1 and
    `out`/{split}_pool as Parquet by country; src of the pool is the id's second character."""
    p = raw_paths(folder, split)
    first, pool = read_records(spark, p["source1"], p["source2"], p["source3"])
    for name, rows in (("s1", first), ("pool", pool)):
        normalize(rows, translit=translit).write.mode("overwrite").partitionBy("country").parquet(f"{out.rstrip('/')}/{split}_{name}")


def load_prepared(spark: SparkSession, out: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The tables that prepare wrote; a filter on country reads that folder alone."""
    return tuple(spark.read.parquet(f"{out.rstrip('/')}/{split}_{name}") for name in ("s1", "pool"))


def replace_countries(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Write a table's countries anew, and no other country's folder: dynamic overwrite of partitions."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def save_dictionary(table: DataFrame, path: str) -> None:
    """A dictionary (src, dst) as JSON lines."""
    table.select("src", "dst").coalesce(1).write.mode("overwrite").json(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from JSON lines, or from one JSON object of src: dst."""
    lines = spark.read.text(path, wholetext=False)
    rows = lines.select(F.from_json("value", "src string, dst string").alias("r")).select("r.*").where("src IS NOT NULL")
    if not rows.isEmpty():
        return rows
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("src", "dst"))
    return whole


def write_report(spark: SparkSession, values: dict, path: str) -> None:
    """A report of plain values as one JSON line."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


EXAMPLES = 5


def violations(body: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples) of the lines (column line) below a list file's header; no rows if they are sound.

    Rules: malformed row, duplicate row, duplicate id in a list, self match, bad prefix, unknown id (with known), missing
    id, extra id; and, as a warning, matches outside of candidates. required and known: id; candidates: q, p. Examples are
    the first five in order; each task keeps no more.
    """
    fields = body.where("line <> ''").withColumn("f", F.split("line", "\t"))
    rows = fields.where(F.size("f") == 2).select(F.get("f", 0).alias("q"), F.filter(F.split(F.get("f", 1), ","), lambda x: x != "").alias("ids"))
    each = rows.select("q", F.explode("ids").alias("p"))
    found = [
        ("malformed row", fields.where(F.size("f") != 2).select(F.col("line").alias("x"))),
        ("duplicate row", rows.groupBy("q").count().where("count > 1").select(F.col("q").alias("x"))),
        ("duplicate id", each.groupBy("q", "p").count().where("count > 1").select(F.concat_ws(":", "q", "p").alias("x"))),
        ("self match", each.where("q = p").select(F.col("q").alias("x"))),
        ("bad prefix", each.where(~F.col("p").rlike("^S[23]-") & (F.col("p") != F.col("q"))).select(F.col("p").alias("x"))),
        ("missing id", required.select(F.col("id").alias("q")).join(rows, "q", "left_anti").select(F.col("q").alias("x"))),
        ("extra id", rows.join(required.select(F.col("id").alias("q")), "q", "left_anti").select(F.col("q").alias("x"))),
    ]
    if known is not None:
        found.append(("unknown id", each.join(known.select(F.col("id").alias("p")), "p", "left_anti").select(F.col("p").alias("x"))))
    if candidates is not None:
        found.append(("warning: not a candidate", each.join(candidates.select("q", "p"), ["q", "p"], "left_anti").select(F.concat_ws(":", "q", "p").alias("x"))))
    return reduce(DataFrame.unionByName, [_counted(rule, bad) for rule, bad in found])


def _counted(rule: str, bad: DataFrame) -> DataFrame:
    some = bad.orderBy("x").limit(EXAMPLES).agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return bad.agg(F.count("*").alias("n")).where("n > 0").crossJoin(F.broadcast(some)).select(F.lit(rule).alias("rule"), "n", "examples")


def validate(spark: SparkSession, path: str, required: DataFrame, col: str = "matched_entity_ids", known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Violations of a list file, its header and the lines below: (rule, n, examples); no rows if it is sound."""
    lines = spark.read.text(path, wholetext=False).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    header = spark.createDataFrame([(f"source1_entity_id\t{col}",)], "want string")
    first = lines.agg(F.min_by("line", "at").alias("line"), F.min("at").alias("at"))
    body = lines.join(F.broadcast(first.select(F.col("at").alias("_first"))), F.col("at") != F.col("_first")).select("line")
    wrong = first.crossJoin(F.broadcast(header)).where("NOT line <=> want").select(F.coalesce("line", F.lit("")).alias("x"))
    return _counted("header", wrong).unionByName(violations(body, required, known, candidates))
