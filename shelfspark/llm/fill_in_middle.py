"""Fill-in-middle transformation: texts cut at line ends into prefix, middle and suffix, in a new order."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from shelfspark.llm.arrow_rows import with_text_columns
from shelfspark.session import table

#: A unit is a line with its end, or what follows the last end.
UNIT = "[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that change, percent of these that begin with the suffix, and what the draws are seeded with.
FIM_PERCENT, SPM_PERCENT, SEED = 100, 50, "7"
#: The library is handed about so many code points at a time, whole units each, as it makes several objects for a unit.
STRETCH = 1 << 18


def drawn(doc_id: object, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four integers below 2**32 from a document's id; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def stretches(text: str, size: int = STRETCH):
    """(place, part) of ``text`` in order, each part ending at a line end or at the end of the text."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size) + 1 or len(text)
        yield at, text[at:end]
        at = end


class Units:
    """The units of a text by the pre-tokenizer's code-point offsets."""

    def __init__(self, unit: str = UNIT):
        self.split = Split(Regex(unit), behavior="isolated")

    def ends(self, text: str) -> list[int]:
        """Where the units end; their number is the list's length."""
        return [at + end for at, part in stretches(text) for _, (_, end) in self.split.pre_tokenize_str(part)]


def cut(text: str, ends: list[int], h1: int, h2: int) -> tuple[int, int]:
    """Where prefix and middle end: after as many units as the smaller and the larger draw say."""
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)


def transformed(text: str, ends: list[int], draws: tuple[int, int, int, int], percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, str, int | None, int | None]:
    """(form, output, code points of the prefix, of the middle)."""
    h1, h2, h3, h4 = draws
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", text, None, None
    a, b = cut(text, ends, h1, h2)
    if h4 % 100 < spm_percent:
        return "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}", a, b - a
    return "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}", a, b - a


def restored(output: str, form: str) -> str:
    """The text that ``transformed`` was given, from what it returned alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output.removeprefix(first).split(MIDDLE)
    one, two = head.split(second)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED) -> DataFrame:
    """Add to ``docs`` its texts in fill-in-middle order.

    Columns: ``keep`` of ``docs`` (all by default), n (units), form (psm, spm or
    plain), prefix_chars and middle_chars (code points; null if plain), output,
    restored (the text rebuilt from output and form). A pre-tokenizer of the
    tokenizers library gives every unit's code-point offsets; their number is n,
    and the draws' ranks among them give the slices. No vocabulary and no
    training. Draws depend on doc_id alone, so reruns agree and repeated rows
    get the same result each. Null and empty texts are plain and empty; so are
    texts that hold a mark, unchanged. A text of any length is cut whole, and
    split in stretches of whole lines. Kept columns may have any name; those
    named like new ones go. An empty table gives an empty one.
    """

    def make():
        units = Units()

        def work(batch: pa.RecordBatch) -> list:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                text = text or ""
                ends = units.ends(text)
                form, output, prefix, middle = transformed(text, ends, drawn(doc_id, seed), percent, spm_percent)
                rows.append((len(ends), form, prefix, middle, output, restored(output, form)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

        return work

    return with_text_columns(docs, "n long, form string, prefix_chars long, middle_chars long, output string, restored string", make, keep, also=["doc_id"])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle order, as digests. Odd rows are as ``fill_in_middle`` says."""
    found = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
