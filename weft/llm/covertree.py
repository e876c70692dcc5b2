"""Embedding near-duplicates: exact cosine-threshold links by a dual traversal of cover trees.

On unit vectors cosine >= t is a Euclidean distance of at most sqrt(2 - 2t). Equal vectors are collapsed to one with a
multiplicity; each label is cut into blocks around pivots, block pairs are pruned by their covering radii, and the
blocks that remain are compared by walking two cover trees (nested levels, halving radii) together: a pair of nodes is
dropped when the distance of its centres exceeds both covering radii plus the threshold. Distances that remain at the
leaves are settled by the cosine in double precision. Pivots go to all tasks; there are max_pivots of them at most. A
label of at most `block` vectors, or one without a sampled pivot, is one cell. In many dimensions distances between
unlike vectors are much the same, so radii prune little, and the cost is that of all pairs within a label.

Null labels, null or empty or zero vectors, and vectors with null or non-finite components link with nothing and are
their own component. Repeated rows link with each other; an empty table gives no rows; other columns are not read, whatever
their names. Equal vectors are ties and share the least id. Very long vectors make blocks larger: `block` bounds their number.
Vectors of different lengths within a label never link.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, local_roots


class CoverTree:
    """Nested levels over the rows of x (unit vectors): radius 2 / 2**k at level k; a node's radius is measured.

    Built from distances to centres alone: each centre looks at those of its parent's rows that no centre before it took.
    """

    def __init__(self, x: np.ndarray, least: float):
        self.x = x
        members = [np.arange(len(x))]
        centres, radii, self.levels = np.zeros(1, int), np.array([self._far(0, members[0]).max()]), []
        r = 2.0
        while True:
            kids, cs, rs, ms = [], [], [], []
            r /= 2
            for centre, own in zip(centres.tolist(), members):
                first = len(cs)
                left = own
                at = centre  # nested: a centre stays one
                while len(left):
                    d = self._far(at, left)
                    inside = d <= r
                    inside |= left == at
                    cs.append(at)
                    ms.append(left[inside])
                    rs.append(d[inside].max(initial=0.0))
                    left = left[~inside]
                    at = int(left[0]) if len(left) else at
                kids.append((first, len(cs)))
            self.levels.append((centres, radii, np.array(kids)))
            centres, radii, members = np.array(cs), np.array(rs), ms
            if r < least or len(cs) == len(x):
                break
        self.levels.append((centres, radii, None))
        self.members = members

    def _far(self, at: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[rows] @ self.x[at])))

    def dump(self, ids: np.ndarray, m: np.ndarray) -> bytes:
        return pickle.dumps((self.x, self.levels, self.members, ids, m), protocol=5)

    @classmethod
    def load(cls, raw: bytes) -> tuple["CoverTree", np.ndarray, np.ndarray]:
        tree = cls.__new__(cls)
        tree.x, tree.levels, tree.members, ids, m = pickle.loads(raw)
        return tree, ids, m


def _distances(a: CoverTree, b: CoverTree, ca, cb, i, j) -> np.ndarray:
    """Centre distances of the node pairs (i, j); by one product where most pairs are asked for."""
    if len(i) * 8 >= len(ca) * len(cb):
        dot = (a.x[ca] @ b.x[cb].T)[i, j]
    else:
        dot = np.concatenate([np.einsum("ij,ij->i", a.x[ca[i[k : k + 65536]]], b.x[cb[j[k : k + 65536]]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


def _expand(kids_a, kids_b, i, j):
    """All child pairs of the node pairs (i, j)."""
    na, nb = kids_a[i, 1] - kids_a[i, 0], kids_b[j, 1] - kids_b[j, 0]
    n = na * nb
    pair = np.repeat(np.arange(len(i)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return kids_a[i[pair], 0] + k // nb[pair], kids_b[j[pair], 0] + k % nb[pair]


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) whose cosine is at least the threshold."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    i = j = np.zeros(1, int)
    depth = max(len(a.levels), len(b.levels))
    for k in range(depth):
        (ca, ra, ka), (cb, rb, kb) = a.levels[min(k, len(a.levels) - 1)], b.levels[min(k, len(b.levels) - 1)]
        near = _distances(a, b, ca, cb, i, j) <= ra[i] + rb[j] + reach
        i, j = i[near], j[near]
        if k + 1 < depth:
            ka = np.stack([np.arange(len(ca)), np.arange(1, len(ca) + 1)], 1) if ka is None or k + 1 >= len(a.levels) else ka
            kb = np.stack([np.arange(len(cb)), np.arange(1, len(cb) + 1)], 1) if kb is None or k + 1 >= len(b.levels) else kb
            i, j = _expand(ka, kb, i, j)
    out = []
    for p, q in zip(i.tolist(), j.tolist()):
        mp, mq = a.members[p], b.members[q]
        s, t = np.nonzero(a.x[mp] @ b.x[mq].T >= cosine)
        out.append((mp[s], mq[t]))
    if not out:
        return i[:0], j[:0]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_embeddings(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, block: int = 1024, max_pivots: int = 512) -> DataFrame:
    """(id_col, n_links, component_id, kept): links of each vector, smallest id reachable over links."""
    v = F.col(vec_col)
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v"), F.coalesce(F.col(label_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0), F.lit(False)).alias("ok"))
    classes = checkpoint(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("label", F.concat_ws(":", F.size("v"), "label")))
    total = classes.count()
    # Pivots: a bounded hash sample, only within labels over a block long. Their cells are cut further by salt below.
    large = classes.groupBy("label").count().where(F.col("count") > block)
    share = min(1.0, min(max_pivots, total / block + 1) / max(1, total))
    chosen = classes.join(large, "label").where(F.xxhash64("rep", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)) < F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64("rep", F.lit(7))).limit(max_pivots).select("label", "rep", "v").collect()
    pivots: dict = {}
    for r in chosen:
        pivots.setdefault(r.label, []).append(r.v)
    pivots = {k: _unit(p) for k, p in pivots.items()}

    def assign(batches):
        for b in batches:
            labels = np.array(b.column("label").to_pylist(), object)
            cell, far = np.full(b.num_rows, -1, np.int32), np.full(b.num_rows, 2.0)
            for label in set(labels.tolist()) & pivots.keys():
                at = np.flatnonzero(labels == label)
                dot = _unit(_matrix(b.column("v").take(pa.array(at)))) @ pivots[label].T
                cell[at], far[at] = dot.argmax(axis=1), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot.max(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("rep"), b.column("m"), b.column("v"), pa.array(cell), pa.array(far)], names=["label", "rep", "m", "v", "cell", "far"])

    cells = checkpoint(classes.select("label", "rep", "m", "v").mapInArrow(assign, "label string, rep long, m long, v array<double>, cell int, far double"))
    sizes = cells.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    blocks = cells.join(sizes.select("label", "cell", F.ceil(F.col("n") / block).alias("parts")), ["label", "cell"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = blocks.groupBy("label", "cell", "salt").agg(F.collect_list("rep").alias("reps"), F.collect_list("m").alias("ms"), F.flatten(F.collect_list("v")).alias("vs"))
    least = np.sqrt(max(0.0, 2 - 2 * cosine)) / 4

    def build(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, m = (b.column(c)[k].values.to_numpy() for c in ("reps", "ms"))
                tree = CoverTree(_unit(b.column("vs")[k].values.to_numpy().reshape(len(ids), -1)), least)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(k, 1) for c in ("label", "cell", "salt")] + [pa.array([tree.dump(ids, m)], pa.binary())], names=["label", "cell", "salt", "tree"])

    # Each block's tree is built once and kept; block pairs meet as trees.
    trees = checkpoint(blocks.mapInArrow(build, "label string, cell int, salt int, tree binary"))
    # Cell pairs that the covering radii leave: pivots are bounded, so these are too.
    radius = {(r.label, r.cell): r.radius for r in sizes.join(large.select("label"), "label", "left_semi").where("cell >= 0").collect()}
    reach, near = np.sqrt(2 - 2 * cosine) + 1e-7, []
    for label, p in pivots.items():
        rad = np.array([radius.get((label, c), -9.0) for c in range(len(p))])
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T))) - rad[:, None] - rad[None, :]
        near += [(label, int(a), int(b)) for a, b in np.argwhere(np.triu(gap <= reach)) if rad[a] >= 0 and rad[b] >= 0]
    spark = table.sparkSession
    own = sizes.where("cell < 0").select("label", F.col("cell").alias("cell"), F.col("cell").alias("other"))
    pairs = own.unionByName(spark.createDataFrame(near, "label string, cell int, other int")) if near else own
    left = trees.select("label", "cell", F.col("salt").alias("sa"), F.col("tree").alias("x"))
    right = trees.select("label", F.col("cell").alias("other"), F.col("salt").alias("sb"), F.col("tree").alias("y"))
    work = left.join(pairs, ["label", "cell"]).join(right, ["label", "other"]).where((F.col("cell") != F.col("other")) | (F.col("sa") <= F.col("sb"))).select("x", "y", ((F.col("cell") == F.col("other")) & (F.col("sa") == F.col("sb"))).alias("self")).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def traverse(batches):
        for p in batches:
            for k in range(p.num_rows):
                yield from _links(p.column(0)[k].as_buffer(), p.column(1)[k].as_buffer(), p.column(2)[k].as_py(), cosine)

    found = checkpoint(work.mapInArrow(traverse, "rep long, links long, root long"))
    count = classes.select("rep", (F.col("m") - 1).alias("links")).unionByName(found.where("links > 0").select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("root IS NOT NULL").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(count, "rep").join(comp, classes.rep == comp.node, "left").select("label", "v", "links", F.coalesce("component", "rep").alias("component"))
    keyed = rows.withColumn("label", F.when(F.col("ok"), F.concat_ws(":", F.size("v"), "label"))).withColumn("key", F.when(F.col("ok"), F.col("v")))
    out = keyed.join(named.withColumnRenamed("v", "key"), ["label", "key"], "left")
    c = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), (F.col("id") == c).alias("kept"))


def _links(x: bytes, y: bytes, same: bool, cosine: float):
    """Link counts, by multiplicity, and a spanning forest for two blocks' trees."""
    a, ids, m = CoverTree.load(x)
    n = len(ids)
    b = a
    if not same:
        b, ids_b, m_b = CoverTree.load(y)
        ids, m = np.concatenate([ids, ids_b]), np.concatenate([m, m_b])
    i, j = dual_pairs(a, b, cosine)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    else:
        j = j + n
    if not len(i):
        return
    count = np.bincount(i, m[j], len(ids)).astype(np.int64) + np.bincount(j, m[i], len(ids)).astype(np.int64)
    order = np.argsort(ids)  # roots are the smallest ids
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    root = ids[order][local_roots(len(ids), rank[i], rank[j])[rank]]
    hit = np.nonzero(count)[0]
    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(root[hit], mask=root[hit] == ids[hit])], names=["rep", "links", "root"])
