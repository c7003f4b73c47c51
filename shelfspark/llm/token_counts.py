"""Token counts by finite-state tokenizer compilation."""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm.arrow_rows import with_text_columns
from shelfspark.session import table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Code points in a chunk, which may end anywhere. States that a process keeps; beyond that it compiles anew.
CHUNK, MOST_STATES = 128, 1 << 18
#: Code points that are read between two looks at the number of states; a window ends at a chunk, and its last state goes on.
WINDOW = 1 << 18
#: White space as Unicode's White_Space has it.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def class_table() -> np.ndarray:
    """The class of each code point, the input alphabet of the word transducer."""
    first = {"L": LETTER, "N": NUMBER}
    found = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    found[list(WHITE)] = SPACE
    return found


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """The vocabulary as a trie over bytes, in which END follows the last byte of a token that ends a word, and which
    tokens may stand side by side: those that merging their concatenation leaves as they are."""

    END = 256

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        ids, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in model["added_tokens"]]
        letters = byte_characters()
        byte = {c: b for b, c in enumerate(letters)}
        inner, last = [ids[c] for c in letters], [ids[c + end] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (x, y) in enumerate(model["model"]["merges"]):
            self.merges.setdefault((ids[x], ids[y]), (rank, ids[x + y]))
        self.symbols: dict[int, list[int]] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, number in ids.items():
            final = text.endswith(end)
            path_ = [byte.get(c, -1) for c in (text[: -len(end)] if final else text)]
            if not path_ or min(path_) < 0:
                continue
            symbols = [inner[x] for x in path_]
            if final:
                symbols[-1] = last[path_[-1]]
                path_.append(self.END)
            if self.merged(symbols) != [number]:
                continue  # no word's merging ever gives it
            self.symbols[number] = symbols
            node = 0
            for x in path_:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][x]
            self.token[node] = number
        self._beside: dict[int, bool] = {}

    def merged(self, tokens: list[int]) -> list[int]:
        """The merges of the vocabulary, each the pair of least rank, the left one of equal ones."""
        tokens = list(tokens)
        if len(tokens) > 64:
            return self._merged_long(tokens)
        none = (len(self.merges) + 1, 0)
        found = [self.merges.get(p, none) for p in zip(tokens, tokens[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            tokens[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = self.merges.get((tokens[i], tokens[i + 1]), none)
            if i:
                found[i - 1] = self.merges.get((tokens[i - 1], tokens[i]), none)
        return tokens

    def _merged_long(self, token: list[int]) -> list[int]:
        n = len(token)
        left, right, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j >= 0 and (found := self.merges.get((token[i], token[j]))):
                heapq.heappush(heap, (found[0], i, token[i], token[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or token[i] != a or token[j] != b:
                continue
            token[i], gone[j] = self.merges[a, b][1], True
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t, g in zip(token, gone, strict=True) if not g]

    def beside(self, a: int, b: int) -> bool:
        """Whether b may follow a in the tokens of a word; a is -1 at its beginning."""
        if a < 0:
            return True
        key = a << 17 | b
        if key not in self._beside:
            self._beside[key] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return self._beside[key]


#: What is known of a word in progress: for each place at which a coming token may begin, the trie node of the bytes since
#: there, the token that ends there (-1: none), and the number of tokens up to there less that of the whole word so far.
Word = tuple[tuple[int, int, int], ...]
BEGIN: Word = ((0, -1, 0),)
#: Modes: no word; letters; other signs; a quote that begins a word; a quote and the first letter of a contraction of two.
NONE, LETTERS, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
PENDING = {QUOTE_R: ("r", "e"), QUOTE_V: ("v", "e"), QUOTE_L: ("l", "l")}


class Transducer:
    """The tokenizer as a deterministic transducer over code points, compiled arc by arc as texts need them.

    A state is a mode of the word splitter and what is known of the word in
    progress. An arc says by how much the number of tokens changes: a token
    counts as soon as it is the last one of the word so far, and an arc on which
    tokens merge has a negative number. White space leads to the first state
    from everywhere. Arcs are kept in an open hash table, so that all chunks of
    a batch of texts step together.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.classes = vocabulary, class_table()
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, Word]] = [(NONE, BEGIN)]
        self.number: dict[tuple[int, Word], int] = {self.states[0]: 0}
        self.arcs = 0
        self._room(16)

    def _room(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.emits = np.zeros(1 << bits, np.int32)

    def size_bytes(self) -> int:
        return self.keys.nbytes + self.to.nbytes + self.emits.nbytes

    # compiling

    def _byte(self, word: Word, b: int) -> tuple[Word, int]:
        """The word after one more byte, and the change in tokens."""
        v, live, last = self.vocabulary, [], None
        for node, before, count in word:
            child = v.children[node].get(b)
            if child is None:
                continue
            live.append((child, before, count))
            if last is None and v.token[child] >= 0 and v.beside(before, v.token[child]):
                last = (v.token[child], count + 1)
        token, more = last
        return (*((n, t, c - more) for n, t, c in live if v.children[n]), (0, token, 0)), more

    def _end(self, word: Word) -> int:
        """The change in tokens when the word ends: its last byte becomes a final one."""
        v = self.vocabulary
        for node, before, count in word:
            child = v.children[node].get(v.END)
            if child is not None and v.beside(before, v.token[child]):
                return count + 1
        raise ValueError("a word without tokens")

    def _read(self, word: Word, character: str) -> tuple[Word, int]:
        total = 0
        for b in character.encode("utf-8", "replace"):
            word, more = self._byte(word, b)
            total += more
        return word, total

    def _begin(self, c: str) -> tuple[int, Word, int]:
        kind = self.classes[ord(c)]
        if kind == SPACE:
            return NONE, BEGIN, 0
        word, more = self._read(BEGIN, c)
        if kind == NUMBER:
            return NONE, BEGIN, more + self._end(word)
        return (LETTERS if kind == LETTER else QUOTE if c == "'" else SIGNS), word, more

    def step(self, mode: int, word: Word, c: str) -> tuple[int, Word, int]:
        """(mode, word, change in tokens) after one more code point."""
        kind = self.classes[ord(c)]
        if mode == NONE:
            return self._begin(c)
        if mode in PENDING:
            first, second = PENDING[mode]
            if c == second:
                word, more = self._read(word, first + second)
                return NONE, BEGIN, more + self._end(word)
            ended = self._end(word)
            mode, word, more = self._begin(first)
            mode, word, rest = self.step(mode, word, c)
            return mode, word, ended + more + rest
        if mode == QUOTE and c in "stmd":
            word, more = self._read(word, c)
            return NONE, BEGIN, more + self._end(word)
        if mode == QUOTE and c in "rvl":
            return {"r": QUOTE_R, "v": QUOTE_V, "l": QUOTE_L}[c], word, 0
        if kind == (LETTER if mode == LETTERS else OTHER):
            word, more = self._read(word, c)
            return (LETTERS if mode == LETTERS else SIGNS), word, more
        ended = self._end(word)
        mode, word, more = self._begin(c)
        return mode, word, ended + more

    def _numbered(self, state: tuple[int, Word]) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def _compile(self, key: int) -> None:
        mode, word, emits = self.step(*self.states[key >> 21], chr(key & 0x1FFFFF))
        state = self._numbered((mode, word))
        if 2 * (self.arcs + 1) > len(self.keys):
            old = self.keys >= 0
            keys, to, emitted = self.keys[old], self.to[old], self.emits[old]
            self._room(64 - int(self.shift) + 2)
            for k, t, e in zip(keys.tolist(), to.tolist(), emitted.tolist(), strict=True):
                self._put(k, t, e)
        self._put(key, state, emits)
        self.arcs += 1

    def _put(self, key: int, to: int, emits: int) -> None:
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[at] >= 0:
            at = (at + 1) & (len(self.keys) - 1)
        self.keys[at], self.to[at], self.emits[at] = key, to, emits

    # running

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The place of each arc; what is not yet compiled, is now."""
        while True:
            at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            held = self.keys[at]
            odd = np.flatnonzero(held != key)
            while len(odd) and (on := held[odd] >= 0).any():
                odd = odd[on]
                at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
                held[odd] = self.keys[at[odd]]
                odd = odd[held[odd] != key[odd]]
            missing = np.unique(key[self.keys[at] != key])
            if not len(missing):
                return at
            for k in missing.tolist():
                self._compile(k)

    def run(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(state at the end, tokens) of chunks that are entered in given states, and their traces: both at each place.

        With the ``known`` traces of another entry, a chunk is read until it is in
        the same state as there; from then on its map is the same.
        """
        most = int(size.max(initial=0))
        states, sums = np.zeros((most + 1, len(start)), np.int32), np.zeros((most + 1, len(start)), np.int32)
        states[0] = entry
        end, total = entry.astype(np.int64), np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        for i in range(most):
            live = live[size[live] > i]
            if not len(live):
                break
            at = self._find(end[live] << 21 | points[start[live] + i])
            end[live] = self.to[at]
            total[live] += self.emits[at]
            if known is None:
                states[i + 1], sums[i + 1] = end, total
                continue
            same = known[0][i + 1, live] == end[live]
            joined = live[same]
            end[joined] = known[0][size[joined], joined]
            total[joined] += known[1][size[joined], joined] - known[1][i + 1, joined]
            live = live[~same]
        return end, total, (states, sums)

    def scan(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, carried: int = 0) -> tuple[np.ndarray, int]:
        """Tokens from each chunk's entry to the end of its text or of the chunks, and the state at the very end.

        ``first`` marks chunks that begin a text; the first chunk of all is
        entered in the state ``carried``. A chunk's map says for a state at its
        entry the state at its exit and the tokens. All maps begin with the first
        state and then take in, all chunks at once, the states in which the maps
        before them end, until none is new: as many rounds as there are states
        that live on across a chunk, mostly one, as another entry mostly is
        forgotten by the end of the word, and the chunk is read no further. Then
        a prefix scan composes the maps, twice as many chunks in each step.
        """
        n = len(start)
        end, total, known = self.run(points, start, size, np.zeros(n, np.int64))
        chunk, entry, exit_, tokens = [np.arange(n)], [np.zeros(n, np.int64)], [end], [total]
        key = lambda c, e: c * np.int64(1 << 32) + e
        keys = key(chunk[0], entry[0])
        ask_chunk, ask_entry = np.arange(1, n)[~first[1:]], end[:-1][~first[1:]]
        if n and carried:
            ask_chunk, ask_entry = np.append(ask_chunk, 0), np.append(ask_entry, carried)
        while len(ask_chunk):
            new = np.setdiff1d(key(ask_chunk, ask_entry), keys)
            if not len(new):
                break
            at, into = new >> 32, new & 0xFFFFFFFF
            out, more, _ = self.run(points, start[at], size[at], into, tuple(t[:, at] for t in known))
            for held, x in zip((chunk, entry, exit_, tokens), (at, into, out, more), strict=True):
                held.append(x)
            keys = np.concatenate([keys, new])
            on = (at + 1 < n) & ~first[np.minimum(at + 1, n - 1)]
            ask_chunk, ask_entry = at[on] + 1, out[on]
        chunk, exit_, tokens = (np.concatenate(x) for x in (chunk, exit_, tokens))
        order = np.argsort(keys, kind="stable")
        follows = (chunk + 1 < n) & ~first[np.minimum(chunk + 1, n - 1)]
        sums, then = np.append(tokens, 0), np.full(len(keys) + 1, len(keys))
        found = np.searchsorted(keys[order], key(chunk[follows] + 1, exit_[follows]))
        then[:-1][follows] = order[found]
        last = np.where(then == len(keys), np.arange(len(keys) + 1), then)
        while (then != len(keys)).any():
            sums, then, last = sums + sums[then], then[then], last[last]
        at = np.arange(n)
        if n and carried and not first[0]:
            at[0] = order[np.searchsorted(keys[order], key(np.int64(0), np.int64(carried)))]
        tail = 0
        if n:
            begin = np.flatnonzero(first)[-1] if first.any() else 0
            tail = int(exit_[last[at[begin]]])
        return sums[at], tail

    def normalised(self, text: str) -> tuple[str, int]:
        """The text as the transducer reads it, and the special tokens taken out of it."""
        special = 0
        for s in self.vocabulary.special:
            if s in text:
                special += text.count(s)
                text = text.replace(s, "\n")
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower(), special

    def counted(self, texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        bodies, out = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            body, out[i] = self.normalised(text or "")
            bodies.append(body)
        whole = "\n".join([*bodies, ""])  # the white space ends each text's last word
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if not len(points):
            return out
        size = np.array([len(b) + 1 for b in bodies])
        n = -(-size // chunk)
        text = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(size) - size)[text] + place * chunk
        sizes = np.minimum(chunk, size[text] - place * chunk)
        carried = 0
        for at in range(0, len(text), max(1, WINDOW // chunk)):
            part = slice(at, at + max(1, WINDOW // chunk))
            if len(self.states) > MOST_STATES:
                state = self.states[carried]
                self.clear()
                carried = self._numbered(state)
            first = place[part] == 0
            counts, carried = self.scan(points, start[part], sizes[part], first, carried)
            heads = first.copy()
            heads[0] = True
            np.add.at(out, text[part][heads], counts[heads])
        return out


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One in a Python process; arcs that one task compiled, the next one has."""
    if path not in _compiled:
        _compiled[path] = Transducer(Vocabulary(path))
    return _compiled[path]


def counted_tokens(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) to ``docs``.

    Columns: ``keep`` of ``docs`` (all by default), then the three. ``path``
    names the vocabulary file, which every worker must have. Strings of special
    tokens in a text are one token each; none are added. A null text is an empty
    one, with no tokens. Texts of any length are read in chunks of CHUNK code
    points that step together. Columns named like the new ones go. Repeated rows get the same result each; an empty table
    gives an empty one.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def make():
        t = transducer(path)

        def work(batch):
            text = batch.column("_text")
            n = t.counted(text.to_pylist())
            return [pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), n, n > limit]

        return work

    return with_text_columns(docs, "n_bytes long, n_tokens long, over_limit boolean", make, keep)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
