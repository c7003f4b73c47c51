"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.arrow_rows import text_rows, with_text_columns
from shelfspark.session import table

#: Length of the vectors, letters of an n-gram (three), and the seed of the letters' vectors.
DIMENSIONS, SEED = 1024, 17
#: Symbols: 0 for what is between words, 1 to 26 for a to z, the rest shared by all other letters.
SYMBOLS = 256
#: Code points of a long text that are looked at together; n-gram vectors that are made together.
PIECE, BLOCK = 1 << 20, 2048


def symbol_table() -> np.ndarray:
    """The symbol of each code point; letters count after lower-casing."""
    found = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            found[c] = 1 + c - 97 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return found


class Profiles:
    """Letter vectors, and n-gram vectors bound from them.

    A letter is a random vector of +1 and -1. The n-gram abc is the elementwise
    product of a's vector permuted twice (rotated by two), b's permuted once,
    and c's. A text is the sum of its n-grams' vectors.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions)).astype(np.float32) * 2 - 1
        self.turned = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.symbols = symbol_table()

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        first, second, third = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
        return self.turned[0][first] * self.turned[1][second] * self.turned[2][third]

    def grams(self, text: str) -> np.ndarray:
        """Codes of the three-letter runs, with one gap symbol around each word; empty without letters.

        A long text is read in pieces; the last two symbols of one go before the next.
        """
        found, before, lettered = [], np.zeros(1, np.int32), False
        for at in range(0, len(text), PIECE):
            points = np.frombuffer(text[at : at + PIECE].replace("Σ", "σ").lower().encode("utf-32-le", "replace"), np.uint32)
            s = np.concatenate([before, self.symbols[points].astype(np.int32)])
            keep = s != 0
            keep[0] = True
            keep[1:] |= s[:-1] != 0
            s = s[keep]
            lettered = lettered or bool(s.any())
            found.append(self._runs(s))
            before = s[-2:]
        found.append(self._runs(np.append(before, 0)) if before[-1] else np.zeros(0, np.int32))
        return np.concatenate(found) if lettered else np.zeros(0, np.int32)

    @staticmethod
    def _runs(s: np.ndarray) -> np.ndarray:
        return s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int32)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, count) of the n-grams of each text."""
        rows, codes, numbers = [], [], []
        for i, text in enumerate(texts):
            found, n = np.unique(self.grams(text or ""), return_counts=True)
            rows.append(np.full(len(found), i))
            codes.append(found)
            numbers.append(n)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(codes), np.concatenate(numbers)

    def bundles(self, n_rows: int, row: np.ndarray, code: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The sums of n-gram vectors, a row for each text."""
        out = np.zeros((n_rows, self.turned[0].shape[1]), np.float32)
        known, at = np.unique(code, return_inverse=True)
        for lo in range(0, len(known), BLOCK):
            inside = (at >= lo) & (at < lo + BLOCK)
            part = known[lo : lo + BLOCK]
            weight = np.zeros((n_rows, len(part)), np.float32)
            np.add.at(weight, (row[inside], at[inside] - lo), number[inside])
            out += weight @ self.vectors(part)
        return out


@functools.lru_cache(1)
def profiles_of(dimensions: int) -> Profiles:
    """Made once in a Python process."""
    return Profiles(dimensions)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` (text, lang) and a unit vector for each.

    A task adds up its texts' vectors by language (each scaled to length 1, so
    that long texts do not outweigh others) and gives a row for each language
    and component; Spark adds them up. The driver gets a row for each of these:
    their number depends on the languages, not on the texts. The languages'
    mean is taken off, as all share most of it.
    """

    def make():
        profiles, total = profiles_of(dimensions), {}

        def work(batch):
            if batch is None:
                for lang, v in total.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)], ["lang", "part", "value"])
                return
            v = _unit(profiles.bundles(batch.num_rows, *profiles.counts(batch.column("_text").to_pylist())))
            langs = np.array(batch.column("lang").to_pylist())
            for lang in np.unique(langs):
                total[lang] = total.get(lang, np.zeros(dimensions)) + v[langs == lang].sum(axis=0, dtype=np.float64)

        return work

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sums = text_rows(known, "lang string, part int, value double", make, ["lang"]).groupBy("lang", "part").agg(F.sum("value").alias("value"))
    found = sums.collect()  # languages * dimensions
    langs = sorted({r["lang"] for r in found})
    place = {lang: i for i, lang in enumerate(langs)}
    out = np.zeros((len(langs), dimensions))
    for r in found:
        out[place[r["lang"]], r["part"]] = r["value"]
    out = _unit(out)
    return langs, _unit(out - out.mean(axis=0)) if len(langs) > 1 else out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def predicted_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to ``docs``: the prototype with the largest cosine, and that cosine.

    Columns: ``keep`` of ``docs`` (all by default), then the two. A text that is
    null or has no letter is ``und`` with score 0; so is every text if nothing
    was learned. Ties go to the first language by name. A negative cosine counts
    as 0. Whole texts are used; a long one is read in pieces without losing the
    n-grams between them. Columns named like the new ones go. Repeated rows get the
    same result each; an empty table gives an empty one.
    """
    dimensions = prototypes.shape[1] if len(langs) else DIMENSIONS

    def make():
        profiles = profiles_of(dimensions)
        goal = prototypes.T.astype(np.float32)

        def work(batch):
            row, code, number = profiles.counts(batch.column("_text").to_pylist())
            if not len(langs):
                return [pa.array(["und"] * batch.num_rows), np.zeros(batch.num_rows)]
            cosine = _unit(profiles.bundles(batch.num_rows, row, code, number)) @ goal
            best = cosine.argmax(axis=1)
            lettered = np.bincount(row, minlength=batch.num_rows) > 0
            names = [langs[b] if on else "und" for b, on in zip(best.tolist(), lettered.tolist(), strict=True)]
            score = np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
            return [pa.array(names), score]

        return work

    return with_text_columns(docs, "lang_pred string, score double", make, keep)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = fit_prototypes(docs.filter(~held_out(F.col("doc_id"))))
    found = predicted_languages(docs, langs, prototypes, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
