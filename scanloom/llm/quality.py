"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import free_name, map_arrow, text_of
from scanloom.plans.stage import stage

TREES, DEPTH, SEED = 24, 3, 7
LASSO = 0.002
STATS = (
    "n_words",
    "word_length",
    "longest_word",
    "distinct_words",
    "repeated_neighbours",
    "capital_words",
    "lower_share",
    "upper_share",
    "digit_share",
    "space_share",
    "stop_share",
    "mark_share",
    "symbol_share",
    "control_share",
    "high_share",
    "n_lines",
    "distinct_lines",
    "stops_per_word",
)


def _classes() -> np.ndarray:
    """Byte value to class: lower, upper, digit, space, sentence stops and commas, ! and ?, other symbols, control, above ASCII."""
    kind = np.full(256, 7)
    kind[128:] = 8
    kind[33:127] = 6
    for k, letters in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, b" \t\n\r"), (4, b".,;:'\"-()"), (5, b"!?")):
        kind[list(letters)] = k
    return np.eye(9)[kind]


_CLASS = _classes()


def text_stats(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATS``; an empty text has zeros."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _CLASS) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    return [
        float(len(words)),
        sum(map(len, words)) / n,
        float(max(map(len, words), default=0)),
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        *shares.tolist(),
        float(len(lines)),
        len(set(lines)) / len(lines),
        (counts[46] + counts[33] + counts[63]) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = np.array([text_stats(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATS))
        cols = [batch.column(0), *(pa.array(c) for c in stats.T)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", *STATS])


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text; null texts count as empty."""
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(taken, _measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


def remainder(id_col: str, n: int) -> Column:
    """CRC-32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def _paths(node, held: tuple = ()) -> Iterator[tuple]:
    """All conjunctions on the way to a node below the root, as sorted (statistic, comparison, threshold)."""
    if held:
        bounds: dict[tuple, float] = {}
        for i, op, at in held:
            known = bounds.get((i, op), at)
            bounds[i, op] = min(known, at) if op == "<=" else max(known, at)
        yield tuple(sorted((STATS[i], op, at) for (i, op), at in bounds.items()))
    if node.subtreeDepth() > 0:
        i, at = node.split().featureIndex(), node.split().threshold()
        yield from _paths(node.leftChild(), (*held, (i, "<=", at)))
        yield from _paths(node.rightChild(), (*held, (i, ">", at)))


def rule_condition(rule: tuple, within: str = "") -> Column:
    held = F.lit(True)
    for name, op, at in rule:
        held = held & (F.col(within + name) <= at if op == "<=" else F.col(within + name) > at)
    return held


class RuleModel:
    """Weighted conjunctions; the score is the logistic of their sum."""

    def __init__(self, base: float, rules: list[tuple[tuple, float]]):
        self.base, self.rules = base, rules

    def score(self, within: str = "") -> Column:
        """The score as a column over the statistics, or over those in a struct (``within`` ends in a dot)."""
        total = F.lit(float(self.base))
        for rule, weight in self.rules:
            total = total + F.when(rule_condition(rule, within), F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Rules from the paths of a forest's trees, weights from a logistic lasso over them.

    ``labelled`` has the statistics and ``label`` (0 or 1; other rows are left
    out). Both fits run on all rows. With no rows the score is 1/2; with one
    class it is that class's share, smoothed.
    """
    rows = labelled.filter(F.col(label).isin(0, 1))
    seen = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = seen.get(1, 0), seen.get(0, 0)
    if not ones or not zeros:
        return RuleModel(float(np.log((ones + 1) / (zeros + 1))), [])
    data = stage(rows.select(F.col(label).cast("double").alias("label"), *STATS), "rule-data").coalesce(16)
    vectors = data.select("label", array_to_vector(F.array(*STATS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird")
    rules = sorted({p for t in forest.fit(vectors).trees for p in _paths(t._call_java("rootNode"))})
    fired = F.array(*[rule_condition(r).cast("double") for r in rules])
    lasso_fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, tol=1e-5)
    model = lasso_fit.fit(data.select("label", array_to_vector(fired).alias("features")))
    weights = model.coefficients.toArray()
    return RuleModel(model.intercept, [(r, w) for r, w in zip(rules, weights) if w != 0.0])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out_of: tuple[int, int] | None = (3, 1),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Score every whole text of ``docs``, learning from the rows that ``labels`` marks.

    ``held_out_of`` (n, r): rows whose remainder modulo n is r teach nothing;
    None learns from all. Inputs of a score are the statistics of the text and
    nothing else. Statistics are taken in one pass and written, 18 numbers a
    row; only they meet the labels, and the score is a column over them.

    Returns doc_id, held_out, score and predicted (score >= 1/2), a row per row
    of ``docs``. Null texts are scored as empty ones, null ids are scored but
    match no label, several labels of one id count as their minimum, labels
    other than 0 and 1 are left out, and an empty table gives no rows.
    """
    rows, model = _learn(docs, labels, held_out_of, id_col, text_col, label_col)
    n, r = held_out_of or (1, 1)
    scored = rows.select("doc_id", (remainder("doc_id", n) == r).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _learn(docs, labels, held_out_of, id_col, text_col, label_col) -> tuple[DataFrame, RuleModel]:
    n, r = held_out_of or (1, 1)
    rows = stage(with_stats(docs, id_col, text_col), "text-stats")
    marks = labels.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    known = rows.filter(remainder("doc_id", n) != r).join(marks, F.col("doc_id") == F.col("__id"))
    return rows, fit(known)


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def stats_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(np.array([text_stats(t) for t in texts], float).reshape(-1, len(STATS)), columns=list(STATS))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    held_out_of: tuple[int, int] | None = (3, 1),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """The rows of ``docs`` that the classifier of ``score_quality`` accepts, with all their columns; none moves."""
    _, model = _learn(docs, labels, held_out_of, id_col, text_col, label_col)
    stats = free_name(docs, "__stats")
    judged = docs.withColumn(stats, stats_column(text_of(text_col)))
    return judged.filter(model.score(f"{stats}.") >= 0.5).drop(stats)
