"""Quality scores by a sparse rule ensemble.

Statistics of each text feed a forest of shallow trees; every path of a tree is a rule, a conjunction of threshold
tests. A logistic regression with lasso penalty weighs the rules and drops most. The rest becomes one Spark column
expression over the statistics, so scoring is a projection.

Null and empty texts have statistics of 0 and are scored like others. Labels with a null quality are not learned from;
of repeated labels of one id all count. Without labels of both kinds every score is the share of label 1, or 0.5 when
there are none. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import held_out, slices, stored, text_bytes, word_hashes

#: Statistics of a text; shares are of bytes (``b_``) or of words (``w_``).
STATISTICS = (
    "n_words", "n_bytes", "word_bytes", "b_upper", "b_digit", "b_blank", "b_line", "b_stop", "b_bang", "b_pipe", "b_symbol", "b_high",
    "w_distinct", "w_repeat", "w_top", "w_symbol", "word_spread", "line_bytes",
)
#: Labelled rows that training reads, about, where there are more: chosen by a hash of the id.
TRAINING_ROWS = 60_000
TREES, DEPTH, LASSO = 24, 3, 0.0005


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _flags(*chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in chars:
        table[list(c.encode())] = True
    return table


_KINDS = {
    "b_upper": _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "b_digit": _flags("0123456789"), "b_blank": _flags(" \t"), "b_line": _flags("\n\r"),
    "b_stop": _flags(".,;:"), "b_bang": _flags("!?"), "b_pipe": _flags("|/\\<>[]{}_"), "b_symbol": _flags("#$%&*@^~+="), "b_high": np.arange(256) >= 128,
}


def statistics_of(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of many texts that lie in one array of bytes."""
    n_rows, sizes = len(offsets) - 1, np.diff(offsets)
    row_of_byte = np.repeat(np.arange(n_rows), sizes)
    counts = np.bincount(row_of_byte * 256 + flat, minlength=n_rows * 256).reshape(n_rows, 256) if n_rows else np.zeros((0, 256))
    out = {name: _share(counts[:, table].sum(axis=1), sizes) for name, table in _KINDS.items()}
    hashes, starts, ends, rows = word_hashes(flat, offsets)
    n_words = np.diff(rows)
    row = np.repeat(np.arange(n_rows), n_words)
    lengths = (ends - starts).astype(float)
    order = np.lexsort((hashes, row))
    sorted_row, sorted_hash = row[order], hashes[order]
    fresh = np.append(True, (sorted_row[1:] != sorted_row[:-1]) | (sorted_hash[1:] != sorted_hash[:-1]))[: len(order)]
    begins = np.flatnonzero(fresh)
    times = np.diff(np.append(begins, len(order)))
    top = np.zeros(n_rows)
    np.maximum.at(top, sorted_row[begins], times)
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    symbols = np.flatnonzero(_KINDS["b_symbol"][flat] | _KINDS["b_bang"][flat] | _KINDS["b_pipe"][flat])
    marked = np.zeros(len(starts), bool)
    holder = np.searchsorted(starts, symbols, side="right") - 1
    marked[holder[holder >= 0]] = True
    total, squares = np.bincount(row, lengths, n_rows), np.bincount(row, lengths**2, n_rows)
    mean = _share(total, n_words)
    return out | {
        "n_words": n_words.astype(float), "n_bytes": sizes.astype(float), "word_bytes": mean,
        "w_distinct": _share(np.bincount(sorted_row[begins], minlength=n_rows), n_words),
        "w_repeat": _share(np.bincount(row[1:][same], minlength=n_rows), n_words), "w_top": _share(top, n_words),
        "w_symbol": _share(np.bincount(row[marked], minlength=n_rows), n_words),
        "word_spread": np.sqrt(np.maximum(0, _share(squares, n_words) - mean**2)), "line_bytes": sizes / (1 + counts[:, 10]),
    }


def with_statistics(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns ``also``, one double per statistic) for every row of ``docs`` (doc_id, text)."""
    columns = ["doc_id", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch.column(1))
            for a, b in slices(np.diff(offsets)):
                made = statistics_of(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in columns], *[pa.array(made[n], pa.float64()) for n in STATISTICS]], [*columns, *STATISTICS])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select("doc_id", "text", *also).mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} double" for n in STATISTICS))


#: A test: (statistic, threshold, whether the value must be above it). A rule is a tuple of tests.
Rule = tuple[tuple[str, float, bool], ...]


def rules_of(node, tests: Rule = ()) -> Iterator[Rule]:
    """Every path of a tree, inner ones too, as a rule."""
    if tests:
        yield tests
    if node.subtreeDepth() > 0:
        name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
        yield from rules_of(node.leftChild(), (*tests, (name, at, False)))
        yield from rules_of(node.rightChild(), (*tests, (name, at, True)))


def holds(rule: Rule) -> Column:
    """The rule as a condition on the statistics."""
    out = F.lit(True)
    for name, at, above in rule:
        out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
    return out


@dataclass
class RuleModel:
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(rows: DataFrame, most: int = TRAINING_ROWS, seed: int = 9) -> RuleModel:
    """The rule model of labelled ``rows`` (doc_id, label 0 or 1, statistics)."""
    share = min(1.0, most / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = stored(rows, "training")
    ones, all_rows = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not all_rows or ones in (0, all_rows):
        share = 0.5 if not all_rows else min(max(ones / all_rows, 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(share / (1 - share))), {})
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(sample)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=seed, featureSubsetStrategy="0.5"
    ).fit(assembled)
    rules = sorted({rule for tree in forest.trees for rule in rules_of(tree._call_java("rootNode"))})
    named = [f"_r{i}" for i in range(len(rules))]
    tested = sample.select(F.col("label").cast("double"), *[holds(r).cast("double").alias(n) for r, n in zip(rules, named)])
    tested = VectorAssembler(inputCols=named, outputCol="_x").transform(tested).select("label", "_x").cache()
    fit = LogisticRegression(featuresCol="_x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(tested)
    tested.unpersist()
    return RuleModel(fit.intercept, {r: w for r, w in zip(rules, fit.coefficients.toArray().tolist()) if abs(w) > 1e-9})


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = 0.7, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, and its columns ``also``; held-out ids are never learned from."""
    stats = stored(with_statistics(docs, also), "statistics")
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label"))
    model = learn(stats.where(~held_out()).join(known, F.col("doc_id") == F.col("_id")).drop("_id"))
    score = F.round(model.score(), 9)
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= accept).cast("int").alias("predicted"), *also)
