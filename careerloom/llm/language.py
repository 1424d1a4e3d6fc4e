"""Language identification by multilingual mixtures.

Each language is a distribution over byte trigrams, counted over all labelled documents. A document is a mixture of
languages; expectation-maximisation finds the proportions, first among all languages, then among the leading one, two
and three. The set of languages with the best likelihood less a penalty per language is chosen.

Texts that are null or hold no letter are ``und`` with score 0, as is every text when nothing is labelled. Rows with a
null language are not learned from. Repeated rows count again. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import held_out, slices, text_bytes

#: Table width of the trigrams; the model holds so many numbers per language, whatever the corpus.
BITS = 15
SMOOTHING = 0.5
FIRST_ROUNDS, ROUNDS = 12, 6
#: Log likelihood that one more language must gain, per logarithm of the number of trigrams.
PENALTY = 2.0
UNKNOWN = "und"

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct trigrams of each text; those of blanks and digits only are left out."""
    low = _FOLDED[flat].astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(low) < 3:
        return row[:0], row[:0], row[:0]
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    ok = (row[:-2] == row[2:]) & (low[1:-1] != 32)
    bucket = ((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - BITS)
    key, count = np.unique((row[:-2][ok] << BITS) | bucket[ok], return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


@dataclass
class LanguageModel:
    names: list[str]
    log_p: np.ndarray  # bucket x language

    @classmethod
    def from_counts(cls, rows: list[tuple[str, int, int]]) -> LanguageModel:
        names = sorted({r[0] for r in rows})
        counts = np.full((1 << BITS, len(names)), SMOOTHING)
        index = {n: i for i, n in enumerate(names)}
        for lang, bucket, n in rows:
            counts[bucket, index[lang]] += n
        return cls(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def mixtures(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n_rows: int) -> np.ndarray:
        """Proportions of the chosen languages in each text (0 for the others); rows without trigrams get 0."""
        languages = len(self.names)
        best = np.zeros((n_rows, languages), np.float32)
        present, begins = np.unique(row, return_index=True)
        if not len(present) or not languages:
            return best
        spread = np.repeat(np.arange(len(present)), np.diff(np.append(begins, len(row))))
        log_p = self.log_p[bucket]
        p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
        weight = count.astype(np.float32)[:, None]
        total = np.add.reduceat(count, begins).astype(np.float32)[:, None]

        def maximise(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                part = p * share[spread]
                part *= weight / np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
                share = np.add.reduceat(part, begins) / total
            fit = np.log(np.maximum((p * share[spread]).sum(axis=1), 1e-30)) * count
            return share, np.add.reduceat(fit, begins)

        share, _ = maximise(np.full((len(present), languages), 1 / languages, np.float32), FIRST_ROUNDS)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        chosen, value = share, np.full(len(present), -np.inf)
        open_ = np.ones(len(present), bool)  # the penalised likelihood rose with the last language added
        for size in range(1, languages + 1):
            some = np.where(rank < size, share + 1e-6, 0).astype(np.float32)
            some, fit = maximise(some / some.sum(axis=1, keepdims=True), ROUNDS if size > 1 else 0)
            penalised = fit - PENALTY * (size - 1) * np.log(total[:, 0] + 1)
            open_ &= penalised > value
            if not open_.any():
                break
            value = np.where(open_, penalised, value)
            chosen = np.where(open_[:, None], some, chosen)
        best[present] = chosen
        return best


def _steps(batch: pa.RecordBatch, text: int):
    flat, offsets = text_bytes(batch.column(text))
    for a, b in slices(np.diff(offsets)):
        yield a, b, trigrams(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def learn(rows: DataFrame) -> LanguageModel:
    """The model of labelled ``rows`` (text, lang). The driver gets one number per language and bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            counts: dict[str, np.ndarray] = {}
            for a, b, (row, bucket, count) in _steps(batch, 0):
                for lang in set(langs[a:b]):
                    mine = langs[a:b][row] == lang if len(row) else np.zeros(0, bool)
                    counts.setdefault(lang, np.zeros(1 << BITS, np.int64))[:] += np.bincount(bucket[mine], count[mine], 1 << BITS).astype(np.int64)
            for lang, table in counts.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(table[at])], ["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long")
    return LanguageModel.from_counts([tuple(r) for r in counted.groupBy("lang", "bucket").agg(F.sum("n")).collect()])


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "lang_pred", "score", "languages", "shares"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (row, bucket, count) in _steps(batch, 1):
                shares = sent.value.mixtures(row, bucket, count, b - a)
                langs = sent.value.names
                texts = batch.column(1).slice(a, b - a).to_pylist()
                out = []
                for text, share in zip(texts, shares):
                    if not langs or not text or not any(map(str.isalpha, text)):
                        out.append((UNKNOWN, 0.0, [], []))
                        continue
                    top = np.argsort(-share, kind="stable")
                    top = top[share[top] > 0] if share.any() else top[:1]
                    score = min(1.0, float(share[top[0]])) if share.any() else 1 / len(langs)
                    out.append((langs[top[0]], score, [langs[i] for i in top], [float(share[i]) for i in top]))
                types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(x, t) for x, t in zip(zip(*out), types)]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """``identified`` with a model of the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    model = learn(docs.where("lang is not null and text is not null").where(~held_out()))
    return identified(docs, model).withColumn("held_out", held_out())
