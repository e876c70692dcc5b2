"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values.

Weights: for each feature (a word, or its first 4 to 8 letters) the log-odds of the share of toxic against other
labelled documents that hold it, under Dirichlet priors in proportion to its share in all (Monroe et al., 2008); those
that don't speak for toxic documents by z-score and log-odds are dropped (a word may just go with a language). A token
scores by its feature of greatest z, any other token scores the drift, which makes clean text score below zero.
A linear scan finds every maximal segment (Ruzzo and Tompa, 1999). Under the token scores of clean documents, the best
segment of n tokens follows an extreme-value law, so a segment of score S has the evidence lambda * S - ln(K * n)
(Karlin and Altschul, 1990); the evidence of the significant segments goes through a logistic fit to the score.

Only labels, and only of at most `sample` labelled rows (chosen by a hash of the id), are learnt from; three in four
give the weights, the rest the logistic fit; copies of a text are learnt from once. Null labels are left out, repeated labels count by their greatest. Null
and empty texts have no tokens and score as documents without evidence. Without toxic labels every score is 0.
Repeated rows score alike; an empty table gives no rows; columns other than those named are not read, whatever their
names. Very long texts are scored whole; of equal features of a token the last in score counts, of equal segments the
first. K is taken as a tenth of lambda times the gain a token, and a thousandth at least: it only shifts all evidence, and
the logistic fit takes the shift back.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

TOKEN = re.compile(r"[^\W_]+")
PREFIX = range(4, 9)  # Model.heads needs 4 at least
SAMPLE, LEAST_Z, LEAST_ODDS, DRIFT, MOST_SCORE, PRIOR = 20_000, 3.5, 1.5, -0.05, 4.0, 50.0


def words_of(text: str | None) -> list[str]:
    """Lower-cased tokens. Where lower case has another length (a dotted capital I), tokens are split before, so that their
    places are those of the text."""
    if not text:
        return []
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in TOKEN.findall(text)]


def features(word: str):
    yield word
    for k in PREFIX:
        if len(word) > k:
            yield word[:k] + "*"


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (z, log-odds)
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    fit: tuple[float, float, float] = (-50.0, 0.0, 0.0)
    drift: float = DRIFT
    memo: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = {f[:4] for f in self.weights}  # a word that begins otherwise has no feature

    def score(self, word: str) -> float:
        s = self.memo.get(word)
        if s is None:
            s = min(MOST_SCORE, max(self.weights.get(f, (0.0, self.drift)) for f in features(word))[1])
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = s
        return s

    def settle(self, s: np.ndarray, counts: np.ndarray) -> None:
        """Drift, lambda and K from the scores of clean tokens: the drift takes back twice what they gain by chance."""
        gain = float(np.maximum(s, 0) @ counts / counts.sum())
        self.drift, self.memo = min(DRIFT, -2 * gain), {}
        self.rate, self.log_k = karlin(np.where(s > 0, s, self.drift), counts)

    def scores(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        out, heads = np.full(len(words), self.drift), self.heads
        at = [k for k, w in enumerate(words) if w[:4] in heads]
        if at:
            memo, score = self.memo, self.score
            out[at] = [memo[w] if (w := words[k]) in memo else score(w) for k in at]
        return out

    def evidence(self, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Greatest evidence, its sum over significant segments, and those segments (first, end, evidence)."""
        cost = self.log_k + math.log(max(1, len(scores)))
        found = [(a, b, self.rate * s - cost) for a, b, s in segments(scores)]
        found = [x for x in found if x[2] > 0]
        return max((x[2] for x in found), default=0.0), sum(x[2] for x in found), found

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.fit
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(best) + c * math.log1p(total)))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in linear time; only tokens that score above zero are visited."""
    at = np.nonzero(scores > 0)[0]
    if not len(at):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # first, end, sum before it, sum with it
    for i in at.tolist():
        first, low, high = i, before[i], before[i + 1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= high:
                stack.append([first, i + 1, low, high])
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, h - l) for a, b, l, h in stack]


def spans(text: str, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Character spans of the segments of a text."""
    places = [m.span() for m in TOKEN.finditer(text)] if found else []
    return [(places[a][0], places[b - 1][1], e) for a, b, e in found]


def karlin(scores: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """lambda with mean exp(lambda * score) = 1 under the clean distribution, and ln K (K about lambda * H / 10)."""
    p = counts / counts.sum()
    if not (scores > 0).any() or p @ scores >= 0:
        return 1.0, 0.0
    low, high = 0.0, 1.0
    while p @ np.exp(np.minimum(high * scores, 500)) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * scores, 500)) < 1 else (low, mid)
    gain = high * float(p @ (scores * np.exp(np.minimum(high * scores, 500))))
    return high, math.log(max(1e-3, 0.1 * high * gain))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most about `sample` labelled rows of those given."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = known.count()
    if not n:
        return Model()
    share = int(min(1.0, sample / n) * (1 << 30))
    part = F.xxhash64(F.col("id"), F.lit(11)).bitwiseAND(F.lit((1 << 30) - 1))
    chosen = known.where(part < share).withColumn("fit", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(4)) == 0)  # bounded by `sample`
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    # Copies of one text count once, or each of its words would seem telling.
    rows = checkpoint(text.join(F.broadcast(chosen), "id").select("t", "y", "fit", F.xxhash64("t").alias("h")).dropDuplicates(["h", "y"]).select("t", "y", "fit"))

    def count(batches):
        held = {(y, k): Counter() for y in (0, 1) for k in (0, *PREFIX)}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y, found = int(y > 0), set(words_of(t))
                held[y, 0].update(found)
                for k in PREFIX:
                    held[y, k].update({w[:k] for w in found if len(w) > k})
        for k in (0, *PREFIX):
            keys = list(held[0, k].keys() | held[1, k].keys())
            yield pa.RecordBatch.from_arrays([pa.array([f + "*" * (k > 0) for f in keys], pa.string()), pa.array([held[1, k][f] for f in keys], pa.int64()), pa.array([held[0, k][f] for f in keys], pa.int64())], names=["f", "a", "b"])

    learn = rows.where("NOT fit")
    n1, n0 = (learn.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first())[:2]
    if not n1 or not n0:
        return Model() if not rows.where("y > 0").count() else Model(fit=(0.0, 0.0, 0.0))
    grouped = learn.select("t", "y").mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 4")
    prior = F.lit(PRIOR) * (F.col("a") + F.col("b")) / F.lit(float(n1 + n0))
    odds = F.log((F.col("a") + prior) / (F.lit(n1 + PRIOR) - F.col("a") - prior + 1e-9)) - F.log((F.col("b") + prior) / (F.lit(n0 + PRIOR) - F.col("b") - prior + 1e-9))
    z = odds / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
    weights = {r.f: (r.z, r.o) for r in grouped.select("f", z.alias("z"), odds.alias("o")).where((F.col("z") >= LEAST_Z) & (F.col("o") >= LEAST_ODDS)).collect()}  # bounded by the sample
    model = Model(weights)

    def tally(batches, model=model):
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(np.round(model.scores(t), 2).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.float64()), pa.array(list(held.values()), pa.int64())], names=["s", "n"])

    clean = learn.where("y <= 0").select("t").mapInArrow(tally, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()  # scores of two decimals
    s, c = np.array([r.s for r in clean] + [MOST_SCORE]), np.array([r.n for r in clean] + [0.5])
    model.settle(s, c)

    def weigh(batches, model=model):
        for b in batches:
            e = [model.evidence(model.scores(t))[:2] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in e], pa.float64()), pa.array([x[1] for x in e], pa.float64())], names=["y", "best", "total"])

    fit = rows.where("fit").select("t", "y").mapInArrow(weigh, "y int, best double, total double").collect()  # a quarter of the sample
    if len({r.y > 0 for r in fit}) == 2:
        x = np.log1p(np.array([[r.best, r.total] for r in fit]))
        model.fit = tuple(logistic(x, np.array([float(r.y > 0) for r in fit])).tolist())
    else:
        model.fit = (math.log((n1 + 0.5) / (n0 + 0.5)), 1.0, 1.0)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): passages hold start, end (characters) and evidence."""

    def run(batches):
        for b in batches:
            p, found = [], []
            for t in b.column(1):
                t = t.as_py()
                best, total, segs = model.evidence(model.scores(t))
                p.append(model.probability(best, total))
                found.append([{"start": a, "end": e, "evidence": v} for a, e, v in spans(t, segs)] if segs else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(found, kind)], names=["id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double, passages array<struct<start int, end int, evidence double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores below `cut`: one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [model.probability(*model.evidence(model.scores(t.as_py()))[:2]) < cut for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
