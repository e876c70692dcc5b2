"""Token ids in a compressed binary table: canonical length-limited Huffman codes from global counts.

File format: a Parquet table of independent blocks (part, block, base, doc_ids, sizes, into, totals, n, bits, marks) and
a one-row Parquet table of the code lengths by id. bits holds the codes of the block's ids, most significant bit first;
marks holds the bit offset of each EVERY-th id, so that a decoder can start anywhere and walk all stretches of a block
side by side by table lookup. Blocks hold at most block_ids ids, long documents are cut, and follow ascending document
id over range partitions; no block depends on another. doc_ids and sizes list a block's documents and their ids in it,
into and totals how many ids of each stand before it and in all, and base the ids of the partition's earlier blocks.

Null and empty texts are one end id. Repeated ids keep all their rows, next to each other in an order fixed by the ids'
bytes; an empty table writes no blocks; columns other than the id and the text are not read, whatever their names. Very
long texts are encoded whole, then cut, so one text and its ids must fit a worker, but no block grows with it. Ids take
two bytes while they wait to be coded where the vocabulary allows that, else four.
"""

from __future__ import annotations

import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_path, table_path
from .tokens import Encoder

EVERY, BLOCK_IDS, LIMIT = 128, 1 << 18, 18
BLOCKS = "part int, block long, base long, doc_ids array<long>, sizes array<long>, into array<long>, totals array<long>, n long, bits binary, marks array<long>"
STAGED = "id long, digest binary, row long, into long, total long, ids binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 where the count is 0."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # Each level: leaves merged with packages of two of the level before; marks which entries are leaves.
    levels, package = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, package])
        leaf = np.concatenate([np.ones(len(leaves), bool), np.zeros(len(package), bool)])
        by = np.argsort(both, kind="stable")
        both, leaf = both[by], leaf[by]
        levels.append(leaf)
        even = len(both) // 2 * 2
        package = both[0:even:2] + both[1:even:2]
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), in order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in order.tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits and the bit offset of each EVERY-th id."""
    size = lengths[ids]
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    # Each code, placed in the 64 bits from its first 32-bit word on, adds to two words; bits never overlap.
    word, shift = start >> 5, 64 - (start & 31) - size
    placed = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    n = (total >> 5) + 2
    sums = np.bincount(word, (placed >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(float), n)
    return sums.astype(">u4").tobytes()[: (total + 7) // 8], start[::EVERY]


def decoder(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of as many bits as the longest code: the id it begins with, and that id's length."""
    codes, limit = canonical(lengths), max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = (1 << limit) >> lengths[order]
    ids, n = np.zeros(1 << limit, np.int64), np.ones(1 << limit, np.int64)
    if len(order):
        assert codes[order[0]] == 0
        ids[: span.sum()], n[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, n


def decode(bits: bytes, marks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block; its stretches advance together, one id a step."""
    if not n:
        return np.empty(0, np.uint32)
    limit = len(table[0]).bit_length() - 1
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.int64)
    at, out = np.asarray(marks, np.int64).copy(), np.zeros((len(marks), EVERY), np.uint32)
    for k in range(EVERY):
        live = len(marks) if k <= (n - 1) % EVERY else len(marks) - 1
        p = at[:live]
        b = p >> 3
        window = ((raw[b] << 24 | raw[b + 1] << 16 | raw[b + 2] << 8 | raw[b + 3]) >> (32 - limit - (p & 7))) & ((1 << limit) - 1)
        out[:live, k] = table[0][window]
        at[:live] += table[1][window]
    return out.reshape(-1)[:n]


def width_of(tokenizer: str) -> str:
    """How ids wait to be coded: in two bytes where every id of the vocabulary fits, else in four."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(known, default=0) < 1 << 16 else "<u4"


def _tokens(batches, path: str, end_id: int, width: str, block_ids: int):
    from pyspark import TaskContext

    enc, end, row = Encoder.of(path, False), np.array([end_id], np.uint32), TaskContext.get().partitionId() << 33
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part, rows = b.slice(at, 512), []
            for doc, ids in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist())):
                ids = np.concatenate([ids, end])
                digest = xxhash.xxh3_128_digest(ids.tobytes())
                rows += [(doc, digest, row, s, len(ids), ids[s : s + block_ids].astype(width).tobytes()) for s in range(0, len(ids), block_ids)]
                row += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "digest", "row", "into", "total", "ids"])


def _counts(batches, width: str):
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column(0):
            if x.is_valid:
                seen = np.bincount(np.frombuffer(x.as_buffer(), width))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
    s = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(total[s])], names=["s", "n"])


def _blocks(batches, lengths: np.ndarray, width: str, block_ids: int):
    from pyspark import TaskContext

    codes, part = canonical(lengths), TaskContext.get().partitionId()
    rows, held, n, block, base = [], [], 0, 0, 0

    def out():
        bits, marks = encode(np.concatenate(held), lengths, codes)
        longs = [pa.array([[r[k] for r in rows]], pa.list_(pa.int64())) for k in range(4)]
        head = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([base], pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *longs, pa.array([n], pa.int64()), pa.array([bits], pa.binary()), pa.array([marks], pa.list_(pa.int64()))], names=["part", "block", "base", "doc_ids", "sizes", "into", "totals", "n", "bits", "marks"])

    for b in batches:
        for doc, into, total, raw in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3)):
            ids = np.frombuffer(raw.as_buffer(), width)
            if held and n + len(ids) > block_ids:
                yield out()
                rows, held, n, block, base = [], [], 0, block + 1, base + n
            rows.append((doc, len(ids), into, total))
            held.append(ids)
            n += len(ids)
    if held:
        yield out()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in ascending id order, to tables `path`/blocks and `path`/code."""
    spark, staged, width = docs.sparkSession, f"{path}/staged", width_of(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    # Tokenised once; the table is needed for the counts, the ranges of ids and the blocks, and goes afterwards. Its row
    # numbers come from partitions, so they hold only because the table is written before anything is ordered by them.
    rows.mapInArrow(partial(_tokens, path=tokenizer, end_id=end_id, width=width, block_ids=block_ids), STAGED).write.option("compression", "zstd").parquet(staged)
    ids = spark.read.schema(STAGED).parquet(staged)
    found = ids.select("ids").mapInArrow(partial(_counts, width=width), "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()  # one row an id of the vocabulary at most
    counts = np.zeros(max((r.s for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r.s] = r.n
    lengths = code_lengths(counts, max(LIMIT, len(found).bit_length()))
    spark.createDataFrame([(lengths.tolist(),)], "lengths array<long>").write.parquet(f"{path}/code")
    order = ["id", "digest", "row", "into"]
    ordered = ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ordered.select("id", "into", "total", "ids").mapInArrow(partial(_blocks, lengths=lengths, width=width, block_ids=block_ids), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    delete_path(spark, staged)


def crc_after(crc: int, zeros: int) -> int:
    """What a run's crc32 adds to that of a text in which `zeros` bytes follow the run: crc32s of the pieces of a text,
    each so moved on, give the whole's by exclusive or. By squaring the matrix of one zero byte over GF(2)."""
    apply = lambda m, v: reduce(lambda a, k: a ^ m[k] if v >> k & 1 else a, range(32), 0)
    bit = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit: shifted right, the polynomial comes in
    square = lambda m: [apply(m, x) for x in m]
    m = square(square(square(bit)))
    while zeros:
        crc = apply(m, crc) if zeros & 1 else crc
        m, zeros = square(m), zeros >> 1
    return crc


def _read(batches, lengths: np.ndarray):
    table = decoder(lengths)
    for b in batches:
        for k in range(b.num_rows):
            ids = decode(b.column("bits")[k].as_py(), b.column("marks")[k].values.to_numpy(), b.column("n")[k].as_py(), table).astype("<u4")
            sizes, into, totals = (b.column(c)[k].values.to_numpy() for c in ("sizes", "into", "totals"))
            end = np.cumsum(sizes)
            raw, start = ids.tobytes(), end - sizes
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(start.tolist(), end.tolist())]
            rest = totals - into - sizes
            for i in np.nonzero(rest)[0].tolist():
                crc[i] = crc_after(crc[i], 4 * int(rest[i]))
            yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values, pa.array(start - into + b.column("before")[k].as_py()), pa.array(totals), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "crc"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), decoded from the tables; start counts the ids of all documents before.

    Blocks stay where they are: only the partitions' totals, one row each, are summed and broadcast, and the digests of
    documents are put together from their blocks.
    """
    lengths = np.array(spark.read.parquet(f"{path}/code").first().lengths, np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row a partition that was written
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("of_part"))
    rows = blocks.join(F.broadcast(parts), "part").select("doc_ids", "sizes", "into", "totals", "n", "bits", "marks", (F.col("of_part") + F.col("base")).alias("before"))
    found = rows.mapInArrow(partial(_read, lengths=lengths), "doc_id long, start long, n_tokens long, crc long")
    return found.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write all ids, then read the files back. The files stay, as the result reads them (common.delete_tables)."""
    spark = docs.sparkSession
    path = table_path(spark, "ids")
    write_ids(docs, path, tokenizer, end_id, id_col, text_col, block_ids)
    return read_ids(spark, path).withColumnRenamed("doc_id", id_col)
