"""Scorers, and out-of-fold stacking over them."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Protocol

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """Adds a probability column to a frame of pairs; neural scorers plug in here."""

    def score(self, df: DataFrame, out: str) -> DataFrame: ...


class TextScorer:
    """Scores text pairs (a, b) in batches; make() loads the model once a task, score(list, list) -> list of floats.

    Rows are sorted by length within partitions, so that batches hold texts of like length.
    """

    def __init__(self, make: Callable[[], Callable[[list, list], list]], a: str = "a", b: str = "b"):
        self.make, self.a, self.b = make, a, b

    def score(self, df: DataFrame, out: str) -> DataFrame:
        make, a, b = self.make, self.a, self.b

        def run(frames):
            fn = make()
            for f in frames:
                yield f.assign(**{out: pd.Series(fn(f[a].tolist(), f[b].tolist()), dtype="float64", index=f.index)})

        rows = df.sortWithinPartitions(F.length(a) + F.length(b))
        return rows.mapInPandas(run, rows.withColumn(out, F.lit(0.0)).schema)


def with_missing(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Trees have no missing values: each feature becomes a value (-1 if null) and a flag."""
    cols = {f"_v_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)) for c in features}
    cols |= {f"_m_{c}": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in features}
    return df.withColumns(cols), list(cols)


class Boosted:
    """A gradient-boosted binary classifier; rows where `val` is true stop the training early."""

    def __init__(self, features: list[str], rounds: int = 20, depth: int = 4, seed: int = 7):
        self.features, self.rounds, self.depth, self.seed, self.model = features, rounds, depth, seed, None

    def fit(self, df: DataFrame, label: str = "y", val: str | None = None) -> "Boosted":
        rows, cols = with_missing(df, self.features)
        tree = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed)
        if val:
            tree = tree.setValidationIndicatorCol(val)
        ready = VectorAssembler(inputCols=cols, outputCol="_x").transform(rows)
        self.model = PipelineModel([tree.fit(ready)])
        return self

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        rows, cols = with_missing(df, self.features)
        ready = VectorAssembler(inputCols=cols, outputCol="_x").transform(rows)
        done = self.model.transform(ready).withColumn(out, vector_to_array("probability")[1])
        return done.select(*df.columns, out)

    def importances(self) -> dict[str, float]:
        """Gain by feature; a value and its flag count together."""
        gains, n = self.model.stages[0].featureImportances, len(self.features)
        return {f: float(gains[k]) + float(gains[n + k]) for k, f in enumerate(self.features)}

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "Boosted":
        self.model = PipelineModel.load(path)
        return self


def two_fold(df: DataFrame, make: Callable[[], Boosted], label: str = "y", fold: str = "fold", val: str = "val", out: str = "prob") -> tuple[list[Boosted], DataFrame]:
    """A model for each fold scores the other fold; validation rows get the mean of both."""
    models = [make().fit(df.where((F.col(fold) == f) | F.col(val)), label, val) for f in (0, 1)]
    parts = [models[1 - f].score(df.where((F.col(fold) == f) & ~F.col(val)), out) for f in (0, 1)]
    return models, reduce(DataFrame.unionByName, [*parts, mean_score(models, df.where(F.col(val)), out)])


def mean_score(models: list, df: DataFrame, out: str = "prob") -> DataFrame:
    """The mean of several models' probabilities."""
    names = [f"_p{k}" for k in range(len(models))]
    for m, n in zip(models, names):
        df = m.score(df, n)
    return df.withColumn(out, sum(F.col(n) for n in names) / len(names)).drop(*names)


def many_seeds(df: DataFrame, make: Callable[[int], Boosted], seeds: list[int], label: str = "y", fold: str = "fold", val: str = "val", out: str = "prob") -> tuple[list[list[Boosted]], DataFrame]:
    """Two-fold stacking once a seed; out is the mean over seeds. Models by seed, then fold."""
    models = [[make(s).fit(df.where((F.col(fold) == f) | F.col(val)), label, val) for f in (0, 1)] for s in seeds]
    return models, rescore(models, df, fold, val, out)


def rescore(models: list[list[Boosted]], df: DataFrame, fold: str = "fold", val: str = "val", out: str = "prob") -> DataFrame:
    """Out-of-fold scores by models that are there (saved and loaded, say): rows of a fold get the mean, over seeds, of the
    models that have not seen it, validation rows that of all models."""
    parts = [mean_score([m[1 - f] for m in models], df.where((F.col(fold) == f) & ~F.col(val)), out) for f in (0, 1)]
    return reduce(DataFrame.unionByName, [*parts, mean_score([x for m in models for x in m], df.where(F.col(val)), out)])


def info_nce(groups: DataFrame, gid: str = "gid", score: str = "s", label: str = "y") -> DataFrame:
    """Listwise loss by group: the mean over positives of -(s - log(e^s + sum of e^s of the negatives)).

    Scores are shifted by the group's greatest before exp, so logits of any size stay finite.
    """
    top = groups.groupBy(gid).agg(F.max(score).alias("_m"))
    x = groups.join(top, gid).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    g = x.groupBy(gid).agg(F.sum(F.when(F.col(label) == 0, F.col("_e")).otherwise(0.0)).alias("_neg"))
    pos = x.where(F.col(label) == 1).join(g, gid)
    gap = F.col(score) - F.col("_m")
    # beside a much greater negative e^s is lost, and so is the positive's share: the log of the negatives remains
    return pos.groupBy(gid).agg(F.avg(F.log(F.col("_e") + F.col("_neg")) - gap).alias("loss"))


def judge_probability(yes: str, no: str, missing: float = -30.0):
    """P(yes) from two log-probabilities."""
    return 1 / (1 + F.exp(F.coalesce(F.col(no), F.lit(missing)) - F.coalesce(F.col(yes), F.lit(missing))))


# What a judge is asked about a pair, and the answers that count.
JUDGE_SYSTEM = "You decide whether two records name the same business. Answer yes or no."
YES, NO = ("yes", "Yes", " yes", " Yes", "YES"), ("no", "No", " no", " No", "NO")


def judge_prompt(a: str, b: str):
    """The question about the texts in columns a and b, as the user's turn."""
    return F.concat(F.lit("Record A: "), F.coalesce(F.col(a), F.lit("")), F.lit("\nRecord B: "), F.coalesce(F.col(b), F.lit("")), F.lit("\nSame business?"))


def best_answer(logprobs: str, answers: tuple[str, ...]):
    """The greatest log-probability of the answers in a map column of next tokens; null if none is there."""
    found = F.filter(F.transform(F.array(*[F.lit(w) for w in answers]), lambda w: F.try_element_at(F.col(logprobs), w)), lambda x: x.isNotNull())
    return F.array_max(found)
