"""Secret scans with multipart credential linking."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm.arrow_rows import with_text_columns
from shelfspark.session import table

#: Base patterns, by kind in the order in which spans with the same start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "linked")
#: The parts of a credential: who, where, and a value that alone would be too weak to report.
IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login|app_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})""", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?:endpoint|host(?:name)?|server|base_?url|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{3,})""", re.ASCII | re.IGNORECASE)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
#: Bits a character that a weak candidate must have, and code points between the parts of one credential.
LEAST_ENTROPY, SCOPE = 3.0, 400

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds. Each kind's own first character is looked for first, as most texts lack it."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _weak(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_ENTROPY


class Parts:
    """Spans of one kind of part, sorted, for the question whether one lies near an interval."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends = sorted(e for _, e in self.spans)

    def near(self, start: int, end: int, scope: int) -> bool:
        """Whether a part ends within ``scope`` before start:end or begins within ``scope`` after it."""
        i, k = bisect.bisect_left(self.ends, start - scope), bisect.bisect_left(self.starts, end)
        return (i < len(self.ends) and self.ends[i] <= start) or (k < len(self.starts) and self.starts[k] <= end + scope)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates with both an identifier and an endpoint within ``scope``, outside base spans."""
    if ":" not in text and "=" not in text:
        return []
    endpoints = Parts([m.span() for m in ENDPOINT.finditer(text)])
    if not endpoints.spans:
        return []
    identifiers = Parts([m.span() for m in IDENTIFIER.finditer(text)] + [(s, e) for s, e, kind in base if kind == "access"])
    if not identifiers.spans:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    first = [s for s, _ in taken]
    reach, most = [], 0
    for _, e in taken:
        reach.append(most := max(most, e))
    out, clear = [], -1
    for m in WEAK.finditer(text):
        s, e = m.span()
        k = bisect.bisect_left(first, e)
        if (k and reach[k - 1] > s) or not _weak(m[0]):
            continue
        if s >= clear and identifiers.near(s, e, scope) and endpoints.near(s, e, scope) and not _within(endpoints, s, e) and not _within(identifiers, s, e):
            out.append((s, e, "linked"))
            clear = e
    return out


def _within(parts: Parts, start: int, end: int) -> bool:
    k = bisect.bisect_right(parts.starts, start)
    return k > 0 and parts.spans[k - 1][1] >= end


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def secret_spans(docs: DataFrame, keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """Add to ``docs`` the secrets in its texts.

    Columns: ``keep`` of ``docs`` (all by default), n_assign, n_access, n_hex,
    n_linked, base_sha256 (of the base spans), spans (all spans as
    kind:start:end by start, then kind; code points, end exclusive). Kind
    ``linked`` holds values that alone are too weak to report, found where an
    identifier and an endpoint lie within ``scope`` code points, from end to
    start: an interval join of the three kinds of part, swept by start in each text. Scopes never
    leave a text, so rows stay in their task. A null text is an empty one and
    has no spans. Repeated rows get the same result each; an empty table gives
    an empty one.
    """

    def make():
        def work(batch):
            rows = []
            for text in batch.column("_text").to_pylist():
                text = text or ""
                base = base_spans(text)
                count = Counter(kind for *_, kind in base)
                extra = linked_spans(text, base, scope)
                listed = _joined(base)
                rows.append((count["assign"], count["access"], count["hex"], len(extra), hashlib.sha256(listed.encode()).hexdigest(), _joined(base + extra) if extra else listed))
            return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]

        return work

    return with_text_columns(docs, "n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string", make, keep)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
