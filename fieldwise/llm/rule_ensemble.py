"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, settled
from .text_stats import counts_of

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_share",
    "comma_share", "distinct_share", "stutter_share", "repeat_share", "dup_line_share", "line_words",
)
TREES, DEPTH, LASSO = 24, 3, 0.002
SAMPLE_ROWS = 200_000  # labelled rows the model is fitted on at most; more are thinned by a hash of the id


def features_of(text: str | None) -> tuple[float, ...]:
    c = counts_of(text)
    words, letters = max(c["n_words"], 1), max(c["n_upper"] + c["n_lower"], 1)
    return (
        math.log1p(c["n_words"]),
        c["word_chars"] / words,
        c["n_upper"] / letters,
        c["n_digits"] / max(c["word_chars"], 1),
        c["n_symbols"] / words,
        c["n_bangs"] / words,
        c["n_pipes"] / words,
        c["n_stops"] / words,
        c["n_commas"] / words,
        c["n_distinct"] / words,
        c["n_stutters"] / words,
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / max(c["n_lines"], 1),
        c["n_words"] / max(c["n_lines"], 1),
    )


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in FEATURES]))
def statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(t) for t in texts], columns=list(FEATURES), dtype="float64")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(stats)[FEATURES[self.feature]]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def rules_of(debug: str) -> list[Rule]:
    """The paths of a forest as conjunctions, from its printed form; every inner node gives one as well as every leaf."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, Condition]] = []
    line_form = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")
    for line in debug.splitlines():
        m = line_form.match(line)
        if not m:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, Condition(int(m[3]), m[4] == ">", float(m[5]))))
        found[_simplified(tuple(c for _, c in path))] = None
    return list(found)


def _simplified(rule: Rule) -> Rule:
    """The tightest bound of each feature and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for c in rule:
        key = (c.feature, c.above)
        tight[key] = c.threshold if key not in tight else (max if c.above else min)(tight[key], c.threshold)
    return tuple(Condition(f, a, t) for (f, a), t in sorted(tight.items()))


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights. `rate` is the answer where nothing could be learned."""

    intercept: float
    rules: tuple[tuple[float, Rule], ...]
    rate: float | None = None

    def score(self, stats: str) -> Column:
        """The probability of label 1 as a column expression over the struct column `stats`."""
        if self.rate is not None:
            return F.lit(float(self.rate))
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = rule[0].column(stats)
            for c in rule[1:]:
                holds = holds & c.column(stats)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame, stats: str, label: str, seed: int = 7) -> Ensemble:
    """Fits on (stats, label) rows; rows without a label of 0 or 1 are left out.

    The trees and the lasso are Spark's own, so rows stay distributed. No rows, or one label only, give a
    constant: the rate of label 1, or one half without rows.
    """
    known = labelled.select(*(F.col(stats)[f].alias(f) for f in FEATURES), F.col(label).cast("double").alias("label"))
    known = settled(known.filter("label in (0.0, 1.0)"), "labelled-statistics")
    by_label = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(by_label.values())
    if len(by_label) < 2:
        return Ensemble(0.0, (), by_label.get(1.0, 0) / total if total else 0.5)
    if total > SAMPLE_ROWS:
        known = known.filter(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 20)) < int((1 << 20) * SAMPLE_ROWS / total))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known).select("features", "label", *FEATURES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=10, subsamplingRate=0.7, featureSubsetStrategy="onethird")
    rules = rules_of(forest.fit(rows.select("features", "label")).toDebugString)
    if not rules:
        return Ensemble(0.0, (), by_label[1.0] / total)
    row = F.struct(*FEATURES)
    held = known.select("label", row.alias("s")).select(
        "label", *(_both(rule).cast("double").alias(f"r{i}") for i, rule in enumerate(rules))
    )
    names = [f"r{i}" for i in range(len(rules))]
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    model = lasso.fit(VectorAssembler(inputCols=names, outputCol="features").transform(held).select("features", "label"))
    weights = [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules, strict=True) if w != 0.0]
    return Ensemble(float(model.intercept), tuple(weights))


def _both(rule: Rule) -> Column:
    holds = rule[0].column("s")
    for c in rule[1:]:
        holds = holds & c.column("s")
    return holds


def with_statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The frame with the struct column of statistics, and that column's name. A null text counts as empty."""
    stats = fresh(df, "_stats")
    return df.withColumn(stats, statistics(F.col(text))), stats


def train_on(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Ensemble:
    """Learns from the documents that have a label; the caller leaves out held-out rows. Statistics are taken before the join, so texts don't move."""
    stated, stats = with_statistics(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    answers = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    return fit(stated.select("doc_id", stats).join(answers, "doc_id"), stats, "label")


def keep_good(documents: DataFrame, model: Ensemble, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, all columns unchanged."""
    stated, stats = with_statistics(documents, text)
    return stated.filter(model.score(stats) >= threshold).drop(stats)
