"""Fill-in-middle and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [None, "", "\n", "one", "a\nb\n\nc", "é\n中文\r\n😀\n" * 7, "has <S> in it\nand more", "x<\nS>y\n<", "  \n\t\n", "long line " * 5000 + "\n" + "\n" * 3000 + "end"]


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = digest(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, monkeypatch):
    from shelfspark.llm import fill_in_middle as op

    rows = [(i, TEXTS[i % len(TEXTS)], "k", "n") for i in range(60)] + [(3, "one", "k", "n"), (None, "a\nb\nc", "k", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, Form string")
    got = op.fill_in_middle(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "_text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fim(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    plain = op.fill_in_middle(docs, ["doc_id"], percent=0)
    assert {r["form"] for r in plain.collect()} == {"plain"}
    assert op.fill_in_middle(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert all(r["output"] == brute_fim(r["doc_id"], r["text"])[-1] for r in op.fill_in_middle(named).collect())


def test_units_in_stretches(monkeypatch):
    from shelfspark.llm import fill_in_middle as op

    text = "ab\n\ncdé\n中\nlast"
    for size in range(1, 20):
        monkeypatch.setattr(op.stretches, "__defaults__", (size,))
        assert op.Units().ends(text) == [3, 4, 8, 10, 14]


SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_faults(rows):
    """Rows in order: (blank, duplicate, truncated, illegal), gaps and a fault for each."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heads = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(heads, heads[1:], strict=False))
    turns = [r[1] for r in rows if r[1] is not None]
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in "bdt"), illegal], faults


def brute_repair(rows, faults):
    """Every edit script by increasing cost and audit, without a grammar automaton: the first whose initials match."""
    heap, n = [(0, "", ())], len(rows)
    whole = re.compile("(s?(ua)+)?")
    beginnings = {"", "s"} | {("s" if s else "") + ("ua" * 20)[:k] for s in (0, 1) for k in range(1, 40)}
    seen = set()
    while True:
        cost, audit, made = heapq.heappop(heap)
        i = sum(x != "I" for x in audit)
        heads = "".join(m[0][:1] for m in made)
        if (i, audit, heads) in seen:
            continue
        seen.add((i, audit, heads))
        if i == n and whole.fullmatch(heads):
            return cost, audit, digest("\n".join(f"{r}:{t}" for r, t in made))
        more = [(5, "I", (r, "")) for r in ("user", "assistant")]
        if i < n:
            _, _, role, text = rows[i]
            more.append((2, "D", None))
            if faults[i] not in ("b", "d"):
                left = 5 if faults[i] == "t" else 0
                more += [(left, "K", (role, text))] if role else []
                more += [(left + 1, "R", (r, text)) for r in ("user", "assistant")]
        for c, letter, row in more:
            new = made + ((row,) if row else ())
            if "".join(m[0][:1] for m in new) in beginnings:
                heapq.heappush(heap, (cost + c, audit + letter, new))


def in_order(spark, rows):
    """Ties of a turn as the operator orders them."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, conv_id long, turn long, role string, text string")
    hashed = df.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")}).collect()
    key = {r["i"]: (r["turn"] is not None, r["turn"] or 0, r["h1"], r["h2"]) for r in hashed}
    return [rows[i] for i in sorted(key, key=key.get)]


def conversations(seed, n):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", None, ""], ["Yes.", "No", "", None, "Why?\n", "Well!", "the end. ", " \t"]
    rows = []
    for conv in range(n):
        turns = rng.integers(0, 9, rng.integers(1, 6))
        for t in turns:
            rows.append((conv if conv else None, None if rng.random() < 0.1 else int(t), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"Text {rng.integers(50)}."))
    return rows


@pytest.mark.parametrize("stretch", [1, 256])
def test_conversation_repair(spark, tmp_path, monkeypatch, stretch):
    from shelfspark.llm import conversation_repair as op

    if stretch != 256:  # local workers are forked after this, or see the module's own value; the pieces are tested below
        monkeypatch.setattr(op, "STRETCH", stretch)
    rows = conversations(stretch, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    broken = brute_damage(rows)
    for conv, r in got.items():
        own = in_order(spark, [x for x in broken if x[0] == conv]) if any(x[0] == conv for x in broken) else []
        counts, faults = brute_faults(own)
        assert [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] == (counts if own else [0] * 5)
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == brute_repair(own, faults), own


def test_repaired_rows(spark):
    from shelfspark.llm import conversation_repair as op

    rows = [("a", 0, "system", "Be kind."), ("a", 1, "user", "Hello?"), ("a", 2, "user", "Again?"), ("a", 3, "assistant", "Yes."), ("b", None, "assistant", "First."), (None, 4, "user", "Cut off")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = op.repairs(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {"a": (2, "KDKK"), "b": (2, "D"), None: (2, "D")}
    out = op.repaired_rows(df, found).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in out] == [("a", 0, "K", "system", "Be kind."), ("a", 1, "K", "user", "Again?"), ("a", 2, "K", "assistant", "Yes.")]
    assert op.repairs(df.limit(0)).count() == 0 and op.repaired_rows(df.limit(0), found.limit(0)).count() == 0


def test_stretches_compose():
    """Any cut of a conversation gives the ways of the whole, and so do the numbers of its pieces."""
    from shelfspark.llm import conversation_repair as op

    rng = np.random.default_rng(2)
    for _ in range(60):
        rows = [("sua t"[rng.integers(5)].strip(), "bdt  "[rng.integers(5)].strip()) for _ in range(rng.integers(0, 14))]
        whole = op.stretch_map(rows)
        assert op.best(whole) == op.ways(rows, 0, True).popitem()[1]
        for cut in range(len(rows) + 1):
            assert op.composed(op.stretch_map(rows[:cut]), op.stretch_map(rows[cut:])) == whole


def test_long_conversation_is_split(spark):
    """One conversation that lies in several ranges, with a turn that crosses them, equals the same as one piece."""
    from shelfspark.llm import conversation_repair as op

    rows = [(7, i // 3, ("user", "assistant", "system")[i * i % 3], f"Turn {i % 400}" + (".", "!", "")[i % 3]) for i in range(3000)]
    rows += [(7, 99999, "user", "Same.")] * 700 + [(k, 0, "user", "Hi.") for k in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    r = op.repairs(df).filter("conv_id = 7").first()
    own = in_order(spark, [x for x in rows if x[0] == 7])
    counts, faults = brute_faults(own)
    assert [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] == counts
    p = op.Piece()
    for (_, turn, role, _), fault in zip(own, faults, strict=True):
        p.add(turn, role[:1], [fault])
    assert (r["cost"], r["audit"]) == p.answer()
    assert op.ways([(x[2][:1], f) for x, f in zip(own, faults, strict=True)][:400], 0, True).popitem()[1] == op.best(op.stretch_map([(x[2][:1], f) for x, f in zip(own, faults, strict=True)][:400]))
    assert list(itertools.islice(op._faults("t", 3, True), 5)) == ["t", "d", "d"]


@pytest.mark.parametrize("own", ["ten", "some"])
def test_templated_pages_do_not_meet(spark, monkeypatch, own):
    """Pages of one template with words of their own: what is compared as whole sets grows with the pages, and no link is lost."""
    from shelfspark.llm import ngram_join as op

    monkeypatch.setattr(op, "TREE_SETS", 100)
    asked, meet, tokens = [], op.meetings, op._Nodes.tokens

    def counted(nodes, rows):
        out = nodes.cut(meet(nodes, rows))
        asked.append(out.count())
        return out

    monkeypatch.setattr(op, "meetings", counted)
    rng, sizes = np.random.default_rng(4), {}
    base = " ".join(f"t{i}" for i in range(120))
    for n in (500, 2000):
        asked.clear()
        texts = [f"{base} " + " ".join(f"o{x}" for x in rng.integers(0, 10**9, 10 if own == "ten" else int(rng.integers(4, 40)))) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: r["component_id"] for r in op.similar_sets(docs).collect()}
        sizes[n] = sum(asked)
        if n == 500:
            sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split() for t in texts)]
            label = list(range(n))
            for i in range(n):
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if label[i] != label[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                        low, high = sorted((label[i], label[j]))
                        label = [low if x == high else x for x in label]
            assert [got[i] for i in range(n)] == label
    assert tokens is op._Nodes.tokens
    assert sizes[2000] <= (0 if own == "ten" else 10 * 2000), sizes


def test_token_counts_in_windows(monkeypatch):
    """Windows, cleared tables and any chunk size change no count; a long odd text does not fill the memory."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from shelfspark.llm import token_counts as op

    path = public_tokenizers.path(op.VOCABULARY)
    library = Tokenizer.from_file(path)
    random.seed(1)
    texts = ["", "don't stop'll 'rx 12 é ΑΣΣ", "ha" * 700, "a" * 999, "'" * 77, "".join(random.choices("abcdefghij +/", k=5000)), " x ", "".join(random.choices("qwertyuiop", k=3000))]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    t = op.Transducer(op.Vocabulary(path))
    for chunk, window, most in ((128, 1 << 18, 1 << 18), (16, 64, 50), (1, 7, 10), (5, 5, 1), (128, 128, 300)):
        monkeypatch.setattr(op, "WINDOW", window)
        monkeypatch.setattr(op, "MOST_STATES", most)
        assert t.counted(texts, chunk).tolist() == want
        assert len(t.states) <= most + 2 * window + 2


def test_repeated_headings_and_loose_names(spark):
    """Headings that a site repeats between unlike texts of articles stay; loose names don't drop a page's own text, site-wide text goes."""
    from shelfspark.llm.html_extraction import extracted_pages

    def texts(pages):
        df = spark.createDataFrame([(i, "https://a.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
        return [r["text"] for r in sorted(extracted_pages(df, ["page_id"]).collect(), key=lambda r: r["page_id"])]

    for i, got in enumerate(texts([f'<div class="legal"><p>Story {i} of the court, told at length.</p></div><p class="footer">All rights reserved</p>' for i in range(12)])):
        assert got == f"Story {i} of the court, told at length."
    recipe = "<article><h1>Cake {0}</h1><h2>Ingredients</h2><p>Flour {0} and eggs.</p><h2>Method</h2><p>Stir {0} times.</p><h2>Share</h2><div><em>Tell your friends</em></div></article>"
    for i, got in enumerate(texts([recipe.format(i) for i in range(12)])):
        assert got == f"Cake {i}\nIngredients\nFlour {i} and eggs.\nMethod\nStir {i} times."
    assert texts(["<article><p>a <label>b</label> c</p></article>"]) == ["a b c"]
