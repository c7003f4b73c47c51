"""Toxicity by a counterfactual-regularised classifier."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.arrow_rows import text_rows, with_text_columns
from shelfspark.llm.text_batches import Words, byte_class, mixed, span_hashes
from shelfspark.session import cut_lineage, table

#: Labelled documents that the fit may see, by a hash of their id, and features that it keeps.
FIT_DOCUMENTS, FEATURES = 12000, 2048
#: Weight of score changes under a swap of identity terms, and of the squared weights.
SWAP_PENALTY, RIDGE = 4.0, 5e-5
#: Bytes of a word's beginning that are features beside the word.
PREFIXES = (4, 5, 6)
#: Letters: a to z and everything beyond ASCII.
LETTERS = byte_class([*range(0x00, 0x61), *range(0x7B, 0x80)])
#: Identity terms, in groups of which one may stand for another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly", "teenage"),
)
_NEXT = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}
_ANY = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str | None:
    """The text with each identity term replaced by another of its group; None if it has none."""
    out, n = _ANY.subn(lambda m: _NEXT[m[0].lower()], text)
    return out if n else None


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every word and word beginning, with repeats."""
    w = Words(column, LETTERS, True)
    parts = [mixed(w.hash)]
    for k in PREFIXES:
        parts.append(mixed(span_hashes(w.data, w.start, np.minimum(w.end, w.start + k)) + np.uint64(k)))
    return np.tile(w.text, len(parts)), np.concatenate(parts)


def distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    return text[first], feature[first]


class Classifier:
    """A logistic model over the presence of known features."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order].astype(np.uint64), weights[order], bias
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.features >> np.uint64(44)).astype(np.int64)] = True

    def known(self, text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of a known feature), each once."""
        near = self.gate[(feature >> np.uint64(44)).astype(np.int64)]
        text, feature = text[near], feature[near]
        if not len(self.features):
            return text[:0], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        same = self.features[at] == feature
        return distinct(text[same], at[same])

    def scores(self, column: pa.Array) -> np.ndarray:
        text, at = self.known(*text_features(column))
        return sigmoid(self.bias + np.bincount(text, weights=self.weights[at], minlength=len(column)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(n: int, rows: np.ndarray, columns: np.ndarray, label: np.ndarray, n_features: int, swap_rows: np.ndarray, swap_columns: np.ndarray, swap_signs: np.ndarray, n_swaps: int, penalty: float = SWAP_PENALTY, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights by Adam over all rows: log loss, ridge, and ``penalty`` times the mean squared score change of swaps.

    A swap is a sparse row of +1 for features that only the text has and -1 for those that only its swapped form has.
    """
    positive = max(1, int(label.sum()))
    weight = np.where(label == 1, math.sqrt((n - positive + 1) / positive), 1.0)
    weight /= weight.sum()
    value = np.zeros(n_features + 1)
    value[-1] = math.log((positive + 0.5) / (n - positive + 0.5))
    first, second = np.zeros_like(value), np.zeros_like(value)
    for k in range(1, rounds + 1):
        score = value[-1] + np.bincount(rows, weights=value[columns], minlength=n)
        pull = weight * (sigmoid(score) - label)
        g = np.bincount(columns, weights=pull[rows], minlength=n_features + 1).astype(np.float64)
        g[:-1] += 2 * RIDGE * value[:-1]
        g[-1] = pull.sum()
        if n_swaps:
            change = np.bincount(swap_rows, weights=swap_signs * value[swap_columns], minlength=n_swaps)
            g += 2 * penalty / n_swaps * np.bincount(swap_columns, weights=swap_signs * change[swap_rows], minlength=n_features + 1)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        value -= 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return value[:-1], float(value[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_classifier(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, features: int = FEATURES, penalty: float = SWAP_PENALTY) -> Classifier:
    """Fit on up to ``documents`` labelled documents.

    Spark counts the documents of either label that have a feature and keeps the
    ``features`` of largest chi-square; the driver then gets, for each of the
    documents, the kept ones that it has, and what a swap of its identity terms
    changes. Without documents of both labels the model scores every text alike,
    as not toxic. Of rows with one doc_id, the least text counts; null texts are
    empty ones. Ties in chi-square go to the smaller feature hash. Labels other
    than 0 and 1, and those without a document, are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(documents)
    # one text for each id; the sample is written once, as it is read for the counts and for the fit
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "inner")
    rows = cut_lineage(met.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text")))

    def counting():
        def work(batch):
            if batch is None:
                return
            text, feature = distinct(*text_features(batch.column("_text")))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[text] == 1
            found, at = np.unique(feature, return_inverse=True)
            n = np.bincount(at, minlength=len(found))
            bad = np.bincount(at, weights=toxic, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(bad)], ["feature", "n", "bad"])

        return work

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n_bad, n_all = sizes.get(1, 0), sum(sizes.values())
    if not n_bad or n_bad == n_all:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), -3.0)
    counts = text_rows(rows, "feature long, n long, bad long", counting, ["toxic"]).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("n >= 3")
    expected = F.col("n") * (n_bad / n_all)
    chi = (F.col("bad") - expected) ** 2 / (expected * (1 - n_bad / n_all) + 0.5)
    best = counts.orderBy(chi.desc(), "feature").limit(features).collect()  # features
    blank = Classifier(np.array([r["feature"] for r in best], np.int64).view(np.uint64), np.zeros(len(best)), 0.0)

    def listing():
        def work(batch):
            if batch is None:
                return
            texts = batch.column("_text").to_pylist()
            pairs = [swapped(t) if t else None for t in texts]
            n = batch.num_rows
            row, at = blank.known(*text_features(batch.column("_text")))
            other_row, other = blank.known(*text_features(pa.array(pairs, pa.string())))
            here, there = np.searchsorted(row, np.arange(n + 1)), np.searchsorted(other_row, np.arange(n + 1))
            has = [at[here[i] : here[i + 1]].tolist() for i in range(n)]
            swap = [None if pairs[i] is None else other[there[i] : there[i + 1]].tolist() for i in range(n)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(has, kind), pa.array(swap, kind)], ["doc_id", "toxic", "has", "swap"])

        return work

    sample = sorted((tuple(r) for r in text_rows(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, has array<long>, swap array<long>", listing, ["doc_id", "toxic"]).collect()), key=lambda r: (r[0], r[2]))  # documents * features at most
    label = np.array([r[1] for r in sample])
    row = np.repeat(np.arange(len(sample)), [len(r[2]) for r in sample])
    column = np.array([c for r in sample for c in r[2]], np.int64)
    changes = [(set(r[2]) - set(r[3]), set(r[3]) - set(r[2])) for r in sample if r[3] is not None]
    swap = [(i, c, sign) for i, both in enumerate(changes) for sign, part in zip((1.0, -1.0), both, strict=True) for c in sorted(part)]
    s_row, s_column, s_sign = (np.array([x[k] for x in swap], kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
    weights, bias = fit_weights(len(sample), row, column, label, len(best), s_row, s_column, s_sign, len(changes), penalty)
    return Classifier(blank.features, weights, bias)


def scored_toxicity(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) to ``docs``.

    Columns: ``keep`` of ``docs`` (all by default), then the two. Null and empty
    texts get the score of a text without any known feature. Repeated rows get
    the same result each; an empty table gives an empty one.
    """

    def make():
        def work(batch):
            score = model.scores(batch.column("_text"))
            return [score, (score >= 0.5).astype(np.int32)]

        return work

    return with_text_columns(docs, "score double, predicted int", make, keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_classifier(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = scored_toxicity(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
