"""Name embeddings and the classifiers on them (M1-M9)."""

from __future__ import annotations

import io
import math
import tempfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.functions.ranks import running_totals
from careerloom.operators.relational import Skew, enrich, hash_bucket, not_in_keys, sample_n, union_all
from careerloom.session import stored

#: Characters of names multiplied at a time, that share one set of word vectors, and that are worth a task.
BLOCK_CHARS, GROUP_CHARS, LEAST_CHARS = 1 << 22, 1 << 28, 1 << 18
#: Bytes of text whose words are told apart at a time; names and (name, word) pairs multiplied at a time; bytes of word vectors
#: that a task holds in memory, before it goes on in a file.
PART_BYTES, NAMES, PAIRS, VECTOR_BYTES = 1 << 24, 1 << 16, 1 << 15, 1 << 27
#: Partial sums added by one task, and Newton steps (halved ones included) after which a model is taken as it is.
FAN_IN, MOST_STEPS = 64, 100
#: What a row brings to its group of names, in the order in which the group's task reads them.
VECTOR, WORD, NAME = 0, 1, 2


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``text.tokens`` (X6) on a batch: all tokens in one array, empty ones included, and the text that each is of."""
    lists = pc.ascii_split_whitespace(texts)
    return np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``PART_BYTES`` of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _words_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a part of a batch with the groups that have it: a bit for each, 64 groups to a slot."""
    for batch in (part for whole in batches for part in _cut(whole)):
        row, token = _tokens(batch.column("_text"))
        coded = token.dictionary_encode()
        group = batch.column("_group").to_numpy()
        wide = 64 * (int(group.max(initial=0)) // 64 + 1)
        pairs = coded.indices.to_numpy().astype(np.int64)
        pairs *= wide
        pairs += group[row]
        place, bit = np.divmod(np.unique(pairs), 64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        bits = np.bitwise_or.reduceat(np.uint64(1) << bit.astype(np.uint64), starts) if len(place) else np.zeros(0, np.uint64)
        word, slot = np.divmod(place[starts], wide // 64)
        words = coded.dictionary.take(pa.array(word))
        yield pa.RecordBatch.from_arrays([words, pa.array(slot, pa.int32()), pa.array(bits.view(np.int64))], ["word", "_slot", "_bits"]).filter(pc.not_equal(words, ""))


def every_word(names: DataFrame, name: str) -> DataFrame:
    """The distinct tokens of all names."""
    rows = names.where(F.col(name).isNotNull()).select(F.lit(0).alias("_group"), F.col(name).cast("string").alias("_text"))
    return rows.mapInArrow(_words_of_batch, "word string, _slot int, _bits long").select("word").distinct()


class _Vectors:
    """Vectors of one group of names, appended batch by batch: up to ``VECTOR_BYTES`` in memory, then in a file that ends with its task."""

    def __init__(self, size: int):
        self.size, self.file, self.bytes, self.kind = size, io.BytesIO(), 0, np.dtype(np.float32)

    def add(self, vectors: pa.Array) -> None:
        dense = pc.fill_null(vectors.flatten(), 0).to_numpy(zero_copy_only=False)
        if len(dense) != len(vectors) * self.size:
            raise ValueError(f"a word vector has not {self.size} numbers")
        self.kind = dense.dtype
        self.bytes += dense.nbytes
        if self.bytes > VECTOR_BYTES and isinstance(self.file, io.BytesIO):
            held, self.file = self.file, tempfile.TemporaryFile()
            self.file.write(held.getbuffer())
        self.file.write(np.ascontiguousarray(dense).data)

    def matrix(self) -> np.ndarray:
        if not self.bytes:
            return np.zeros((0, self.size))
        if isinstance(self.file, io.BytesIO):
            return np.frombuffer(self.file.getbuffer(), self.kind).reshape(-1, self.size)
        self.file.flush()
        return np.memmap(self.file, self.kind, "r").reshape(-1, self.size)


def _copied(values: pa.Array) -> pa.Array:
    """A copy: a part of a batch would keep the whole batch in memory."""
    return values.take(pa.array(np.arange(len(values))))


class _Group:
    """What one group of names has brought so far: vectors and their ids, words and the ids of their vectors, names to multiply."""

    def __init__(self, size: int):
        self.size, self.vectors, self.ids, self.words, self.of, self.names = size, _Vectors(size), [], [], [], []
        self.dense = None

    def add(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == NAME:
            self.names.append(rows.select(["_key", "_text"]))
        elif kind == VECTOR:
            self.vectors.add(rows.column("vec"))
            self.ids.append(_copied(rows.column("_id")))
        else:
            self.words.append(_copied(rows.column("_text")))
            self.of.append(_copied(rows.column("_id")))

    def _settle(self) -> None:
        """The vectors as a matrix, and for each word the row that holds its vector, or -1."""
        self.dense, ids = self.vectors.matrix(), pa.concat_arrays(self.ids) if self.ids else None
        if ids is None or not self.of:  # no vector, or each word is the id of its own
            self.words, self.at = ids, np.arange(len(self.dense), dtype=np.int32)
        else:
            self.at = pc.fill_null(pc.index_in(pa.concat_arrays(self.of), value_set=ids), -1).to_numpy()
            self.words = pa.concat_arrays(self.words)
        self.ids = self.of = None

    def product(self) -> Iterator[pa.RecordBatch]:
        """Means of the block of names added last: sparse counts times dense vectors."""
        if not self.names:
            return
        names, self.names = pa.Table.from_batches(self.names).combine_chunks(), []
        if self.dense is None:
            self._settle()
        size, dense = self.size, self.dense
        row, token = _tokens(names.column("_text").chunk(0))
        code = np.full(len(row), -1, np.int64)
        if self.words is not None and len(token):
            coded = token.dictionary_encode()
            found = pc.index_in(self.words, value_set=coded.dictionary)  # the block's words are far fewer than the group's
            here = found.is_valid().to_numpy(zero_copy_only=False)
            place = np.full(len(coded.dictionary), -1, np.int64)
            place[found.drop_null().to_numpy()] = self.at[here]
            code = place[coded.indices.to_numpy()]
        row, code = row[code >= 0], code[code >= 0]
        pair, count = np.unique(row * np.int64(max(1, len(dense))) + code, return_counts=True)
        row_of, vector_of = np.divmod(pair, max(1, len(dense)))
        total = np.zeros((len(names), size))
        for lo in range(0, len(pair), PAIRS):
            part = slice(lo, lo + PAIRS)
            starts = np.flatnonzero(np.diff(row_of[part], prepend=-1))
            total[row_of[part][starts]] += np.add.reduceat(dense[vector_of[part]].astype(np.float64) * count[part, None], starts)
        mean = total / np.maximum(np.bincount(row, minlength=len(names)), 1)[:, None]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * size), pa.array(mean.ravel()))
        yield from pa.table([names.column("_key"), vectors], ["_key", "embedding"]).to_batches()


def _mean_vectors(size: int):
    """Means for rows sorted by group, kind and block: a group's vectors and words are kept, its names pass by in blocks."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = _Group(size), None
        for batch in batches:
            place = batch.column("_order").to_numpy()
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
            for lo, hi in zip(starts, [*starts[1:], len(place)]):
                here = int(place[lo])
                if here != at:
                    yield from group.product()
                    group, at = group if at is not None and here >> 34 == at >> 34 else _Group(size), here
                group.add(here >> 32 & 3, batch.slice(lo, hi - lo))
                if sum(part.num_rows for part in group.names) >= NAMES:
                    yield from group.product()
        yield from group.product()

    return multiply


def embed_names(names: DataFrame, vocab: DataFrame, name: str, size: int, key: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Mean of the word vectors of each distinct name; zeros when no word is known (M1).

    ``vocab`` has ``word`` and ``vec`` of ``size`` numbers, or ``word`` and
    ``vec_id``, the row of ``vectors`` (``vec_id`` and ``vec``) that holds the
    word's vector.  Words are matched as written; a word without a row there is
    unknown, a null vector or number counts as 0.  Names are dealt into blocks of about ``BLOCK_CHARS`` characters,
    and blocks into groups of about ``GROUP_CHARS``.  A vector goes to a group
    once, however often the group has its words; the blocks of a group then
    pass by its vectors one after the other, and a block's means are one
    product of its word counts with them.  ``key`` is a unique id to carry in
    place of a long text.
    """
    rows = names.where(F.col(name).isNotNull())
    rows = rows.select(key, name) if key else rows.select(name).distinct()
    key = key or name
    total = rows.agg(F.sum(F.length(name))).first()[0] or 0
    tasks = 2 * names.sparkSession.sparkContext.defaultParallelism
    groups = max(1, total // GROUP_CHARS, min(tasks, total // LEAST_CHARS))
    blocks = groups * max(1, math.ceil(total / (groups * BLOCK_CHARS)))
    block = F.pmod(F.xxhash64(*dict.fromkeys([key, name])), F.lit(blocks)).cast("int")
    placed = rows.select(F.col(key).alias("_key"), F.col(name).cast("string").alias("_text"), block.alias("_block")).withColumn("_group", F.col("_block") % groups)
    worded = placed.select("_group", "_text").mapInArrow(_words_of_batch, "word string, _slot int, _bits long")
    used = worded.repartition("word").groupBy("word", "_slot").agg(F.bit_or("_bits").alias("_bits"))
    # a word has one row per slot, and a vector too: none is hot
    group = F.expr(f"explode(filter(sequence(64 * _slot, least(64 * _slot + 63, {groups - 1})), g -> bit_get(_bits, g % 64) = 1))").alias("_group")
    if vectors is None:
        parts = [enrich(used, vocab.select("word", "vec"), "word", how="inner", skew=Skew()).select(group, F.lit(VECTOR).alias("_kind"), F.col("word").alias("_id"), "vec")]
    else:
        found = stored(enrich(used, vocab.where("vec_id is not null").select("word", "vec_id"), "word", how="inner", skew=Skew()), "words")
        wanted = found.groupBy("vec_id", "_slot").agg(F.bit_or("_bits").alias("_bits"))
        brought = enrich(wanted, vectors.select("vec_id", "vec"), "vec_id", how="inner", skew=Skew())
        parts = [
            brought.select(group, F.lit(VECTOR).alias("_kind"), F.col("vec_id").alias("_id"), "vec"),
            found.select(group, F.lit(WORD).alias("_kind"), F.col("vec_id").alias("_id"), F.col("word").alias("_text")),
        ]
    zeros = F.array_repeat(F.lit(0.0), size).cast(parts[0].schema["vec"].dataType)
    parts = [parts[0].withColumn("vec", F.coalesce("vec", zeros)), *parts[1:], placed.withColumn("_kind", F.lit(NAME))]
    order = F.shiftleft(F.col("_kind").cast("long"), 32) + F.coalesce("_block", F.lit(0))  # one number, sorted without comparing rows
    together = union_all(*parts).withColumn("_order", F.shiftleft(F.col("_group").cast("long"), 34) + order).drop("_block", "_kind")
    # for each row, Spark goes back over the null lists at the end of its batch
    together = together.withColumn("vec", F.coalesce("vec", F.array().cast(together.schema["vec"].dataType)))
    kind = rows.schema[key].dataType.simpleString()
    dealt = together.repartitionById(groups, "_group").sortWithinPartitions("_order").drop("_group")
    return dealt.mapInArrow(_mean_vectors(size), f"_key {kind}, embedding array<double>").withColumnRenamed("_key", key)


def l2_normalised(vec: Column | str) -> Column:
    """Vector divided by its length; a zero vector stays as it is (M2)."""
    v = F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(length == 0, x).otherwise(x / length))


def train_xy(labels: DataFrame, embeddings: DataFrame, label: str, on: str = "company_name") -> DataFrame:
    """``features`` and ``y`` of the names that have both a label and an embedding (M3)."""
    known = labels.where(F.col(label).isNotNull()).select(on, F.col(label).cast("double").alias("y"))
    return enrich(known, embeddings.select(on, "embedding"), on, how="inner").select(
        on, "y", array_to_vector("embedding").alias("features")
    )


@dataclass
class NameClassifier:
    """A fitted logistic regression on shifted and scaled features: weights, the intercept last."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, embeddings: DataFrame, probability: str, on: str = "company_name") -> DataFrame:
        """Probability of each name (M8)."""
        rows = embeddings.select(on, array_to_vector("embedding").alias("features"))
        return self.score_features(rows, probability).select(on, probability)

    def score_features(self, rows: DataFrame, probability: str) -> DataFrame:
        slope = self.weights[:-1] / self.scale
        offset = float(self.weights[-1] - slope @ self.shift)
        weights = F.array(*[F.lit(float(w)) for w in slope])
        margin = F.aggregate(F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w), F.lit(offset), lambda s, x: s + x)
        return rows.withColumn(probability, 1 / (1 + F.exp(-margin)))


@dataclass
class _Fit:
    """One model being fitted: the rows it uses, its features' shift and scale, the current and the last accepted weights."""

    rows: str
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    accepted: np.ndarray
    loss: float = math.inf
    step: np.ndarray | None = None
    done: bool = False


def _partial_sums(fits: list[_Fit], columns: list[str], c: float):
    """Per partition and model: loss, gradient and second derivatives of the loss, without the penalty."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(fits[0].weights)
        sums = np.zeros((len(fits), 1 + d + d * d))
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            used = dict(zip(columns, (batch.column(f"use_{i}").to_numpy(zero_copy_only=False) for i in range(len(columns)))))
            for at, fit in enumerate(fits):
                rows = used[fit.rows]
                z = np.column_stack([(x[rows] - fit.shift) / fit.scale, np.ones(int(rows.sum()))])
                margin = z @ fit.weights
                p = 1 / (1 + np.exp(-margin))
                sums[at, 0] += c * (np.logaddexp(0, margin) - y[rows] * margin).sum()
                sums[at, 1 : 1 + d] += c * z.T @ (p - y[rows])
                sums[at, 1 + d :] += c * (z.T @ (z * (p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums.ravel()], pa.list_(pa.float64()))], ["part", "sums"])

    return add_up


def _added(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    return pa.table([pa.array([rows[0]["part"]]), pa.array([np.sum([r["sums"] for r in rows], axis=0)], pa.list_(pa.float64()))], ["part", "sums"])


def _tree_sum(partials: DataFrame, parts: int) -> np.ndarray:
    """Sum of one row per partition, in the order of the partitions, ``FAN_IN`` at a time."""
    width = FAN_IN
    while parts > 1:
        partials = partials.groupBy(F.floor(F.col("part") / width)).applyInArrow(_added, "part long, sums array<double>")
        parts, width = -(-parts // FAN_IN), width * FAN_IN
    return np.array(partials.first().sums)


def _stepped(fit: _Fit, sums: np.ndarray, tolerance: float) -> None:
    """One Newton step; a step that made the penalised loss larger is halved."""
    d = len(fit.weights)
    free = np.append(fit.weights[:-1], 0.0)
    loss = sums[0] + 0.5 * free @ free
    if fit.step is not None and loss > fit.loss + 1e-12 * abs(fit.loss):
        fit.step = fit.step / 2
    else:
        fit.accepted, fit.loss = fit.weights, loss
        second = sums[1 + d :].reshape(d, d) + np.diag(np.append(np.ones(d - 1), 0.0))
        fit.step = np.linalg.lstsq(second, sums[1 : 1 + d] + free, rcond=None)[0]
    fit.done = np.abs(fit.step).max() <= tolerance * max(1.0, np.abs(fit.accepted).max())
    fit.weights = fit.accepted - fit.step


def fit_all(train: DataFrame, fits: Mapping[str, tuple[str, bool]], c: float = 1.0, tolerance: float = 1e-9) -> dict[str, NameClassifier]:
    """Logistic regressions by iteratively reweighted least squares, all in the same passes (M5).

    ``fits`` names each model's condition on the rows of ``train`` (``features``,
    ``y`` and more) and whether its features are standardised.  The objective is
    half the squared weights plus ``c`` times the sum of losses; the intercept
    is free.  A pass gives every open model its gradient and second derivatives,
    summed over the partitions in a fixed tree; the step itself is a system of
    one row per feature.  Where all rows of a model are alike, it answers with
    their label.
    """
    conditions = list(dict.fromkeys(rows for rows, _ in fits.values()))
    used = [F.coalesce(F.expr(r), F.lit(False)).alias(f"use_{i}") for i, r in enumerate(conditions)]
    rows = stored(train.select(vector_to_array("features").alias("features"), F.col("y").cast("double").alias("y"), *used), "rows")
    one = F.col("y") == 1
    vector = array_to_vector("features")
    facts = rows.agg(F.max(F.size("features")).alias("d"), *[f for i in range(len(conditions)) for f in (
        F.count_if(f"use_{i}").alias(f"n_{i}"), F.count_if(F.col(f"use_{i}") & one).alias(f"ones_{i}"),
    )]).first()
    moments = {}
    scaled = {conditions.index(r) for r, standardise in fits.values() if standardise and facts[f"n_{conditions.index(r)}"]}
    if scaled:
        summary = Summarizer.metrics("mean", "variance")
        moments = rows.agg(*[summary.summary(vector, F.col(f"use_{i}").cast("double")).alias(str(i)) for i in sorted(scaled)]).first().asDict()
    open_fits, out = {}, {}
    for name, (condition, standardise) in fits.items():
        i = conditions.index(condition)
        n, ones, d = facts[f"n_{i}"], facts[f"ones_{i}"], facts.d or 0
        shift, scale = np.zeros(d), np.ones(d)
        if standardise and n:
            deviation = np.sqrt(moments[str(i)]["variance"].toArray() * (n - 1) / n)
            shift, scale = moments[str(i)]["mean"].toArray(), np.where(deviation > 0, deviation, 1.0)
        if ones in (0, n):
            out[name] = NameClassifier(shift, scale, np.append(np.zeros(d), math.inf if n and ones == n else -math.inf))
        else:
            open_fits[name] = _Fit(condition, shift, scale, np.zeros(d + 1), np.zeros(d + 1))
    spread = rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    for _ in range(MOST_STEPS):
        at_work = [f for f in open_fits.values() if not f.done]
        if not at_work:
            break
        partials = rows.mapInArrow(_partial_sums(at_work, conditions, c), "part long, sums array<double>")
        for fit, sums in zip(at_work, _tree_sum(partials, spread + 1).reshape(len(at_work), -1)):
            _stepped(fit, sums, tolerance)
    return out | {name: NameClassifier(f.shift, f.scale, f.weights) for name, f in open_fits.items()}


def standardised(train: DataFrame) -> DataFrame:
    """``scaled``: features less their mean, over their population deviation; 0 where a feature is constant (M4)."""
    n = train.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    return scaler.transform(train).withColumn("scaled", F.transform(vector_to_array("scaled"), lambda x: x * factor))


def fit_classifier(train: DataFrame, c: float = 1.0, standardise: bool = False) -> NameClassifier:
    """Logistic regression on ``features`` and ``y``, optionally on standardised features (M4, M5)."""
    return fit_all(train, {"all": ("true", standardise)}, c)["all"]


def cross_validated_auc(train: DataFrame, c: float = 1.0, folds: int = 5, on: str = "company_name") -> DataFrame:
    """``auc_mean`` and ``auc_sd`` (population) over the folds (M7).

    A row's fold is a hash of its name, so it is the same in every run; the
    models of all folds are fitted in the same passes.
    """
    dealt = stored(train.withColumn("fold", hash_bucket(on, folds)), "folds")
    models = fit_all(dealt, {str(k): (f"fold <> {k}", False) for k in range(folds)}, c)
    one_each = [rank_auc(models[str(k)].score_features(dealt.where(F.col("fold") == k), "p"), "p", "y") for k in range(folds)]
    return reduce(DataFrame.unionByName, one_each).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_sd"))


def rank_auc(scored: DataFrame, score: str, y: str) -> DataFrame:
    """Exact area under the ROC curve (M6): share of positive-negative pairs in the right order,
    ties counting half.  The order comes from running totals per distinct score."""
    rows = scored.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(
        F.lit("all").alias("g"), F.col(score).alias("s"),
        F.when(F.col(y) == 1, 1).otherwise(0).alias("pos"), F.when(F.col(y) == 1, 0).otherwise(1).alias("neg"),
    )
    totals = running_totals(rows, "g", "s", ["pos", "neg"])
    pairs = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return totals.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(pairs).alias("_u")).select(
        "n_pos", "n_neg", F.try_divide("_u", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc")
    )


def score_names(rows: DataFrame, embeddings: DataFrame, classifiers: dict[str, NameClassifier], on: str = "company_name") -> DataFrame:
    """``prob_<label>`` of every classifier on each row by name (M8): each distinct name is scored once."""
    used = enrich(embeddings.select(on, "embedding"), rows.select(on).distinct(), on, how="inner")
    scored = used.select(on, array_to_vector("embedding").alias("features"))
    for label, classifier in classifiers.items():
        keep = scored.select(on, "features", *[c for c in scored.columns if c.startswith("prob_")])
        scored = classifier.score_features(keep.withColumn("_raw", F.col("features")), f"prob_{label}").drop(
            "features"
        ).withColumnRenamed("_raw", "features")
    return enrich(rows, scored.drop("features"), on)


def holdout(names: DataFrame, train_names: DataFrame, n: int = 200, seed: int = 42, on: str = "company_name") -> DataFrame:
    """Seeded sample of names outside the training set (M9)."""
    return sample_n(not_in_keys(names.select(on).distinct(), train_names, on), n, on, seed)


def holdout_auc(
    names: DataFrame, labels: DataFrame, embeddings: DataFrame, classifier: NameClassifier, label: str, on: str = "company_name"
) -> DataFrame:
    """AUC of a classifier on the labelled hold-out names (M9)."""
    known = labels.join(names.select(on), on, "left_semi")
    xy = train_xy(known, embeddings, label, on)
    return rank_auc(classifier.score_features(xy, "p"), "p", "y")
