"""Quality rules with line sequence labelling by a linear-chain CRF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.arrow_rows import text_rows, with_text_columns
from shelfspark.llm.text_batches import SPACED, Words, mixed, span_hashes
from shelfspark.session import table

#: Labelled documents, by a hash of their id, and lines of each that the fit may see.
FIT_DOCUMENTS, FIT_LINES = 3000, 200
#: A document stays if content lines have at least this share of its word characters.
CONTENT_SHARE = 0.5
FEATURES = ("one", "few words", "word length", "symbols", "exclamations", "bars", "capitals", "digits", "sentence end", "seen before", "same word again", "repeated words", "no words", "first line")


def _table(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


SYMBOLS = _table(b"#*$%&|<>")
CAPITALS, DIGITS = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))


def repeated(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their text."""
    key = mixed(value ^ mixed(text.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.searchsorted(twice, key)
    return twice[np.minimum(at, len(twice) - 1)] == key


class Lines:
    """Words, lines and counts of a slice of texts."""

    def __init__(self, column: pa.Array):
        w = self.words = Words(column, SPACED, False)
        n, data = len(w.count), w.data
        breaks = np.flatnonzero(data == 0x0A)
        per_text = np.diff(np.searchsorted(breaks, w.offsets)) + 1
        self.start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([w.offsets[1:], breaks]))
        self.text = np.repeat(np.arange(n), per_text)
        self.bounds = np.concatenate([[0], np.cumsum(per_text)])
        self.of_word = np.searchsorted(self.start, w.start, "right") - 1
        self.n_words = np.bincount(self.of_word, minlength=len(self.start))
        value = span_hashes(data, self.start, self.end)
        self.again = np.zeros(len(self.start), bool)
        worded = np.flatnonzero(self.n_words > 0)
        twice = worded[repeated(self.text[worded], value[worded])]
        if len(twice):
            key = mixed(value[twice] ^ mixed(self.text[twice].astype(np.uint64) + np.uint64(1)))
            _, first = np.unique(key, return_index=True)
            later = np.ones(len(twice), bool)
            later[first] = False
            self.again[twice[later]] = True
        at, windows = w.windows(5)
        at = at[repeated(w.text[at], windows)]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        self.covered = np.cumsum(edge[:-1]) > 0
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.word_chars = points[w.end] - points[w.start]

    def per_text(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)

    def base(self) -> dict[str, np.ndarray]:
        """The plain counts of each text."""
        w = self.words
        out = {
            "n_words": w.count.astype(np.int64),
            "word_chars": self.per_text(self.word_chars, w.bounds),
            "n_symbols": self.per_text(SYMBOLS[w.data], w.offsets),
            "n_dup_lines": self.per_text(self.again, self.bounds),
            "n_repeat_words": self.per_text(self.covered, w.bounds),
        }
        out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
        return out

    def by_line(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_word, weights=values, minlength=len(self.start))

    def features(self) -> np.ndarray:
        """One row of FEATURES for each line."""
        w, data = self.words, self.words.data
        size = np.maximum(1, self.end - self.start)
        words = np.maximum(1, self.n_words)

        def share(found: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(found)])
            return (total[self.end] - total[self.start]) / size

        same = np.zeros(len(w.hash), bool)
        if len(same):
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        stop = data[np.maximum(self.end - 1, 0)] if len(data) else np.zeros(len(self.end), np.uint8)
        first = np.zeros(len(self.start))
        first[self.bounds[:-1]] = 1
        return np.column_stack([
            np.ones(len(self.start)),
            self.n_words < 4,
            np.minimum(self.by_line(self.word_chars) / words, 20) / 10,
            np.minimum(10 * share(SYMBOLS[data]), 2),
            np.minimum(10 * share(data == 0x21), 2),
            np.minimum(10 * share(data == 0x7C), 2),
            2 * share(CAPITALS[data]),
            2 * share(DIGITS[data]),
            np.isin(stop, list(b".!?")) & (self.end > self.start),
            self.again,
            np.minimum(4 * self.by_line(same) / words, 2),
            2 * self.by_line(self.covered) / words,
            self.n_words == 0,
            first,
        ]).astype(np.float64)


class Chain:
    """A linear chain over lines with the labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray | None = None, move: np.ndarray | None = None):
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else weights
        self.move = np.zeros((2, 2)) if move is None else move

    @staticmethod
    def _turns(bounds: np.ndarray) -> list[np.ndarray]:
        """For each place in a chain, the lines there; the longest chains come first."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        first, size = bounds[:-1][order], size[order]
        return [first[: np.searchsorted(-size, -t, "left")] + t for t in range(int(size[0]) if len(size) else 0)]

    def decode(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label sequence of each chain (Viterbi); ties go to content."""
        emit, turns = x @ self.weights, self._turns(bounds)
        best, back = emit.copy(), np.zeros(emit.shape, np.int8)
        for t in turns[1:]:
            step = best[t - 1][:, :, None] + self.move[None]
            back[t] = step[:, 1, :] >= step[:, 0, :]
            best[t] = emit[t] + step.max(axis=1)
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in reversed(turns[1:]):
            label[t - 1] = back[t, label[t]]
        return label

    def gradient(self, x: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the mean log-likelihood of the labels, by forward and backward sums."""
        emit, turns = x @ self.weights, self._turns(bounds)
        ahead, after = emit.copy(), np.zeros(emit.shape)
        for t in turns[1:]:
            ahead[t] = emit[t] + np.logaddexp.reduce(ahead[t - 1][:, :, None] + self.move[None], axis=1)
        for t in reversed(turns[1:]):
            after[t - 1] = np.logaddexp.reduce(self.move[None] + (emit[t] + after[t])[:, None, :], axis=2)
        whole = np.logaddexp.reduce(ahead + after, axis=1)
        chance = np.exp(ahead + after - whole[:, None])
        truth = np.eye(2)[y]
        move, score = np.zeros((2, 2)), float((emit * truth).sum())
        for t in turns[1:]:
            pair = np.exp(ahead[t - 1][:, :, None] + self.move[None] + (emit[t] + after[t])[:, None, :] - whole[t][:, None, None])
            move -= pair.sum(axis=0)
            np.add.at(move, (y[t - 1], y[t]), 1)
            score += self.move[y[t - 1], y[t]].sum()
        score -= whole[bounds[:-1]].sum()
        n = max(1, len(x))
        return x.T @ (truth - chance) / n, move / n, score / n

    def fit(self, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Chain:
        state = [np.zeros_like(self.weights), np.zeros_like(self.move)]
        spread = [np.zeros_like(self.weights), np.zeros_like(self.move)]
        for k in range(1, rounds + 1):
            *steps, _ = self.gradient(x, y, bounds)
            for i, (value, g) in enumerate(((self.weights, steps[0]), (self.move, steps[1]))):
                g = g - ridge * value
                state[i] = 0.9 * state[i] + 0.1 * g
                spread[i] = 0.99 * spread[i] + 0.01 * g * g
                value += rate * (state[i] / (1 - 0.9**k)) / (np.sqrt(spread[i] / (1 - 0.99**k)) + 1e-8)
        return self


def fit_chain(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, lines: int = FIT_LINES) -> Chain:
    """Fit the chain on the lines of up to ``documents`` labelled documents, at most ``lines`` of each.

    A document with more lines gives so many consecutive ones, from a place that
    a hash of its id draws. Of rows with one doc_id, the least text counts.

    Every line first has its document's quality as label; after the fit, lines of
    good documents keep theirs, those of bad documents take the decoded label,
    and the chain is fitted again. Without labels all weights are 0, and every
    line decodes as content.
    """
    order = [F.xxhash64(F.lit(9), "doc_id"), F.col("doc_id")]
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(*order).limit(documents)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "inner")
    rows = met.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(3), "doc_id"))

    def make():
        def work(batch):
            if batch is None:
                return
            got = Lines(batch.column("_text"))
            x, good = got.features(), batch.column("quality").to_numpy(zero_copy_only=False)
            ids, draw = batch.column("doc_id"), batch.column("draw").to_pylist()
            for i in range(batch.num_rows):
                lo, hi = int(got.bounds[i]), int(got.bounds[i + 1])
                lo += draw[i] % max(1, hi - lo - lines + 1)
                part = x[lo : min(hi, lo + lines)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1), pa.array([int(good[i])], pa.int64()), pa.array([part.ravel().tolist()], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

        return work

    sample = text_rows(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality long, x array<double>", make, ["doc_id", "quality", "draw"])
    found = sorted(((r["doc_id"], r["quality"], r["x"]) for r in sample.collect()), key=lambda r: (r[0], r[2]))  # documents * lines at most
    if len({q for _, q, _ in found}) < 2:
        return Chain()
    parts = [np.array(x).reshape(-1, len(FEATURES)) for *_, x in found]
    sizes = np.array([len(p) for p in parts])
    x, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
    good = np.repeat(np.array([q for _, q, _ in found]), sizes)
    chain = Chain().fit(x, good, bounds)
    return Chain(chain.weights, chain.move).fit(x, np.where(good == 1, 1, chain.decode(x, bounds)), bounds)


def scored_lines(docs: DataFrame, chain: Chain, keep: list[str] | None = None, share: float = CONTENT_SHARE) -> DataFrame:
    """Add base counts, content_share, line_labels and kept to ``docs``.

    Columns: ``keep`` of ``docs`` (all by default), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share (of word
    characters, in lines that the chain marks as content), line_labels (bytes: 1
    for each content line, else 0), kept. Null and empty texts have one line
    without words and fail the base rules. Texts of any length are whole
    chains. Ties between labels go to content. Repeated rows get the same result
    each; an empty table gives an empty one. Columns named like the new ones go.
    """

    def make():
        def work(batch):
            got = Lines(batch.column("_text"))
            base = got.base()
            label = chain.decode(got.features(), got.bounds)
            chars = got.by_line(got.word_chars)
            inside = got.per_text(np.where(label == 1, chars, 0), got.bounds) / np.maximum(1, base["word_chars"])
            each = [label[a:b].astype(np.uint8).tobytes() for a, b in zip(got.bounds[:-1], got.bounds[1:], strict=True)]
            return [*base.values(), inside, pa.array(each, pa.binary()), ~base["base_failed"] & (inside >= share)]

        return work

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, line_labels binary, kept boolean"
    return with_text_columns(docs, fields, make, keep)


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """scored_lines with a chain that is fitted on ``labels`` (doc_id, quality) of ``docs``.

    Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
    names are as scored_lines and fit_chain say.
    """
    return scored_lines(docs, fit_chain(docs, labels), keep)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
