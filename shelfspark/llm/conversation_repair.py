"""Conversation structure repair: Dijkstra on the implicit (turn index, grammar state) edit lattice."""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage, ship_package, table

SPACE = " \t\n\x0b\x0c\r"
#: Faults of a row, the first that holds.
BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
#: Costs of the edits; a truncated row that is not deleted adds its own.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
#: Grammar (s?(ua)+)? over role initials: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
STATES, ACCEPTING, ENDS = (0, 1, 2, 3), (0, 3), {0: 4, 1: 3, 2: 2, 3: 2}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Rows of a long conversation that one lattice covers; the maps of its stretches are composed.
STRETCH = 256

Row = tuple[str, str]  # initial, fault
Way = tuple[int, str]  # cost, audit
Map = dict[tuple[int, int], Way]  # (state before, state after) to the best way


def ways(rows: list[Row], entry: int, whole: bool = False) -> dict[int, Way]:
    """The least (cost, audit) from ``entry`` to each state after ``rows``, in the order in which they are popped.

    With ``whole``, to the first popped accepting end node alone. Two ways of
    one cost to a node never have one audit as the other's beginning (what
    follows could only be insertions, which cost), so the smaller audit stays
    the smaller one whatever comes after, and so do the ways of stretches.
    """
    heap, settled, ends = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        wanted = WANTED[state][1]
        if i == len(rows):
            if not whole or state in ACCEPTING:
                ends[state] = (cost, audit)
                if whole or len(ends) == ENDS[entry]:
                    return ends
        else:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                stay = cost + (LEFT_TRUNCATED if fault == TRUNCATED else 0)
                heapq.heappush(heap, (stay + REROLE, audit + "R", i + 1, wanted))
                if (state, initial) in STEP:
                    heapq.heappush(heap, (stay + KEEP, audit + "K", i + 1, STEP[state, initial]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, wanted))
    return ends


def stretch_map(rows: list[Row]) -> Map:
    return {(p, q): way for p in STATES for q, way in ways(rows, p).items()}


def composed(a: Map, b: Map) -> Map:
    out: Map = {}
    for ((p, q), (cost, audit)), (x, r) in itertools.product(a.items(), b):
        if x == q:
            more, rest = b[x, r]
            way = (cost + more, audit + rest)
            if (p, r) not in out or way < out[p, r]:
                out[p, r] = way
    return out


def best(found: Map) -> Way:
    return min(way for (p, q), way in found.items() if p == 0 and q in ACCEPTING)


@dataclass
class Piece:
    """What is known of consecutive rows of one conversation; a few numbers and the ways through full stretches."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    rows: list[Row] = field(default_factory=list)
    maps: list[tuple[int, Map]] = field(default_factory=list)  # (level, map), composed like the digits of a counter

    def add(self, turn: int | None, initial: str, faults: Iterable[str]) -> None:
        """Rows of one turn that are equal but for their faults."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        for fault in faults:
            self.illegal += self.last is not None and (self.last, initial) not in LEGAL
            self.first, self.last = initial if self.first is None else self.first, initial
            self.blank += fault == BLANK
            self.duplicate += fault == DUPLICATE
            self.truncated += fault == TRUNCATED
            self.rows.append((initial, fault))
            if len(self.rows) == STRETCH:
                self._close()

    def _close(self) -> None:
        level, found = 0, stretch_map(self.rows)
        while self.maps and self.maps[-1][0] == level:
            found = composed(self.maps.pop()[1], found)
            level += 1
        self.maps.append((level, found))
        self.rows = []

    def ways(self) -> Map:
        """The ways through all rows, from every state."""
        if self.rows or not self.maps:
            self._close()
        found = self.maps[-1][1]
        for _, before in reversed(self.maps[:-1]):
            found = composed(before, found)
        return found

    def answer(self) -> Way:
        return best(self.ways()) if self.maps else ways(self.rows, 0, True).popitem()[1]

    def counts(self) -> list:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring pieces, as rows of PIECE, as one."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + ((a["last"], b["first"]) not in LEGAL)
    out["turns"] = a["turns"] + b["turns"] - (b["low"] is not None and a["high"] == b["low"])
    out |= {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    return out


PIECE = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
ANSWER = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _name(kind) -> str:
    return kind.simpleString()


def _described(rows: DataFrame) -> DataFrame:
    """``rows`` with nulls filled, turn as a number, and two hashes of role and text, which also order the rows of one turn."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    slim = rows.select("conv_id", rows["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return slim.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


ORDER = ["turn", "h1", "h2"]


def _tokens(slim: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, initial, fault, n, fresh): equal rows of one turn as one; fresh where no earlier row has this role and text."""
    first = slim.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("at"))
    marks = first.select("conv_id", F.col("at.turn").alias("turn"), "h1", "h2", F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("fresh"))
    each = slim.withColumns({"n": F.lit(1).cast("long"), "fresh": F.lit(False)})
    same = each.unionByName(marks).groupBy("conv_id", *ORDER)
    return same.agg(F.max("initial").alias("initial"), F.max("fault").alias("fault"), F.sum("n").alias("n"), F.max("fresh").alias("fresh"))


def _faults(fault: str, n: int, fresh: bool) -> Iterator[str]:
    """The faults of n equal rows in turn: blank ones are blank; of others all but a fresh first are duplicates."""
    if fault == BLANK:
        return itertools.repeat(BLANK, n)
    return itertools.chain([fault] if fresh else [], itertools.repeat(DUPLICATE, n - fresh))


def repairs(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text; more columns may be there).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    (initials of the edits in order). Rows come by turn, nulls first, and within
    a turn by hashes of role and text. Null roles and texts are one space; a
    null conv_id is a conversation. An empty role has no initial and can't be
    kept as it is. Texts stay where they are: only two hashes, an initial and a
    fault of each row are shuffled. Equal rows of a turn are counted before
    that. The rest is dealt in ranges of (conv_id, turn), so that a long
    conversation is split over tasks; each task runs the search on what lies in
    its range, in stretches of STRETCH rows, and hands on the least (cost,
    audit) between grammar states. The few conversations that cross a range are
    put together from these. Rows without a conversation give none: an empty
    table gives an empty result.
    """
    kind = _name(rows.schema["conv_id"].dataType)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise("")
    slim = cut_lineage(_described(rows).select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))
    ranged = _tokens(slim).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    fields = f"conv_id {kind}, part long, closed boolean, gaps long, {PIECE}, cost long, audit string, ways array<struct<p: int, q: int, cost: long, audit: string>>"

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, met, schema = TaskContext.get().partitionId(), None, 0, None
        out: list[dict] = []

        def ended(closed: bool) -> None:
            conv_id, p = held
            row = {"conv_id": conv_id, "part": part, "closed": closed, "gaps": p.counts()[0], **{k: getattr(p, k) for k in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")}}
            if closed:
                row["cost"], row["audit"] = p.answer()
            else:
                row["ways"] = [{"p": a, "q": b, "cost": c, "audit": s} for (a, b), (c, s) in p.ways().items()]
            out.append(row)

        for batch in batches:
            schema = schema or _arrow(batch.schema.field("conv_id").type)
            for conv_id, turn, initial, fault, n, fresh in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "n", "fresh")), strict=True):
                if held is None or conv_id != held[0]:
                    if held:
                        ended(met > 1)
                    held, met = (conv_id, Piece()), met + 1
                held[1].add(turn, initial, _faults(fault, n, fresh))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if held:
            ended(False)
            yield pa.RecordBatch.from_pylist(out, schema)

    ship_package(rows.sparkSession)
    found = cut_lineage(ranged.mapInArrow(pieces, fields))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, schema = None, None, None

        def ended() -> pa.RecordBatch:
            cost, audit = best(now)
            row = {"conv_id": held["conv_id"], "gaps": held["high"] - held["low"] + 1 - held["turns"] if held["turns"] else 0, **{k: held[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                own = {(w["p"], w["q"]): (w["cost"], w["audit"]) for w in row["ways"]}
                if held is not None and row["conv_id"] == held["conv_id"]:
                    held, now = {"conv_id": row["conv_id"], **joined(held, row)}, composed({k: v for k, v in now.items() if k[0] == 0}, own)
                    continue
                if held is not None:
                    yield ended()
                held, now = row, own
        if held is not None:
            yield ended()

    names = [f.split(" ")[0] for f in ANSWER.split(", ")]
    split = found.filter(~F.col("closed")).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(whole, f"conv_id {kind}, {ANSWER}")
    return found.filter("closed").select("conv_id", *names).unionByName(split)


def _arrow(kind: pa.DataType) -> pa.Schema:
    way = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    numbers = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    more = [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("ways", pa.list_(way))]
    return pa.schema([("conv_id", kind), ("part", pa.int64()), ("closed", pa.bool_()), ("gaps", pa.int64()), *numbers, *more])


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, turn, role, text) of the repaired rows, in order, from rows that follow their conversation's audit."""
    first, held, audit, at, state = True, None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = WANTED[state]
            at += 1
            yield held, "I", None, role, ""

    for batch in batches:
        for conv_id, listed, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text")), strict=True):
            if listed is not None:
                if not first:
                    yield from inserted()
                first, held, audit, at, state = False, conv_id, listed, 0, 0
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "R":
                role, state = WANTED[state]
            elif edit == "K":
                state = STEP[state, role[:1]]
            if edit != "D":
                yield held, edit, turn, role, text
    if not first:
        yield from inserted()


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows, in one stream; sorted outside of memory."""
    heads = found.select("conv_id", "audit", *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("h1", "long"), ("h2", "long"))])
    both = heads.unionByName(_described(rows).withColumn("audit", F.lit(None).cast("string")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER).drop("h1", "h2")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, turn, role, text), from ``rows`` and their ``repairs``.

    Inserted rows have a null turn and an empty text. A conversation's rows pass
    through a task one batch at a time; none is held. Odd rows are as
    ``repairs`` says.
    """
    kind = _name(rows.schema["conv_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def kept() -> Iterator[pa.RecordBatch]:
            nonlocal own
            for batch in batches:
                own = batch.schema.field("conv_id").type
                yield batch

        place, before = 0, object()
        edited = _edited(kept())
        while part := list(itertools.islice(edited, 512)):
            places = []
            for row in part:
                place = place + 1 if row[0] == before else 0
                before = row[0]
                places.append(place)
            columns = list(zip(*part, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], own), pa.array(places, pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3]), pa.array(columns[4])], ["conv_id", "place", "edit", "turn", "role", "text"])

    return _with_audits(rows, found).mapInArrow(run, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired ``role:text``, joined by newlines; conversations left empty are not listed.

    SHA-256 reads its input in one sequence, so a conversation is one task's
    stream here, however long; it is never held.
    """
    kind = _name(rows.schema["conv_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def kept() -> Iterator[pa.RecordBatch]:
            nonlocal own
            for batch in batches:
                own = batch.schema.field("conv_id").type
                yield batch

        done, digest, before = [], None, None
        for conv_id, _, _, role, text in _edited(kept()):
            if digest is None or conv_id != before:
                if digest is not None:
                    done.append((before, digest.hexdigest()))
                before, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
            if len(done) == 512:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], own), pa.array([d for _, d in done])], ["conv_id", "repaired_sha256"])
                done = []
        if digest is not None:
            done.append((before, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], own), pa.array([d for _, d in done])], ["conv_id", "repaired_sha256"])

    return _with_audits(rows, found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults that a checksum of conv_id and turn draws; nulls are one space.

    Of twenty rows about one is dropped, one loses its text, one its ends of
    sentences, one is there twice, and one is a user's.
    """
    key = F.concat(F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(rows["turn"].cast("string"), F.lit(" ")))
    role, text = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, cheapest repair and the digest of what it gives. Odd rows are as ``repairs`` says."""
    whole = table(spark, sf_dir, "conversations")
    rows = damaged(whole)
    found = cut_lineage(repairs(rows))
    digests = repaired_digests(rows, found).withColumnRenamed("conv_id", "d_conv_id")
    ids = whole.select("conv_id").distinct()
    answers = found.withColumnRenamed("conv_id", "r_conv_id")
    both = ids.join(answers, F.col("conv_id").eqNullSafe(F.col("r_conv_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
