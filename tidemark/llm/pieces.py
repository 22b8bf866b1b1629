"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs.

A vocabulary of merge type gives each piece a score. Encoding starts with one symbol a character and keeps an agenda of
adjacent pairs that form a piece, best score first and leftmost among equals; the best pair is joined, its new neighbours
enter the agenda, and it goes on until no pair forms a piece. Characters without a piece become byte pieces.

No piece runs over the border between a non-space and a space, or over characters that occur in no longer piece (line
breaks among them); both are verified when the vocabulary is loaded. So no pair over such a border ever enters the agenda,
what happens on one side never depends on the other, and the ids of a text are those of its parts, one after the other. Each
distinct part is encoded once and remembered in a table of bounded size. The parts that a slice of texts needs for the first
time run their agendas side by side, a row of a matrix each (`rows_merged`); long parts have a heap each (`merged`).

Checks, of which any difference stops the job: every part encoded for the first time is compared with the sentencepiece
library, many to a call with line breaks between them; the library's decode(ids) of every whole text must spell that text,
so no part is missing, doubled or out of place, and a text for which it doesn't is compared with the library's ids as a whole,
as is the first text of every slice. Decoding is the library's decode(ids).

Defined results: a null or empty text gives no ids and an empty decoded text; texts of any length are encoded whole;
repeated rows give repeated results; extra columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import require, with_computed, worker_state

SPACE = "▁"
#: Distinct words that a Python worker remembers in each of two generations, and the longest word remembered.
REMEMBERED, LONGEST = 100_000, 48
#: Parts of up to so many characters run their agendas in a matrix, of so many rows.
SHORT, ROWS = 48, 2048
#: Parts in a call of the library.
COMPARED = 256
NEVER = np.float32(np.inf)


class Pairs:
    """Numbers of the pieces that pairs of symbols form: an open hash table in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self.slots(keys)
        left = np.arange(len(keys))
        while len(left):  # of keys that want one free slot the first takes it, the others go on to the next slot
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[at[taken]], self.values[at[taken]] = keys[taken], values[taken]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.last

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self.slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            there = self.keys[at[left]]
            out[left] = np.where(there == keys[left], self.values[at[left]], -1)
            left = left[(there != keys[left]) & (there >= 0)]
        return out


class Agenda:
    """Encoder for one merge-type model (its bytes)."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.remembered = remembered
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        usable = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in usable}
        self.costs = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte pieces")
        longer = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            raise ValueError("a piece holds a space after another character; texts can't be cut at spaces")
        inner = set("".join(longer))
        alone = "".join(c for c in map(chr, [*range(32), *range(48, 58)]) if c not in inner)
        if "\n" not in alone:
            raise ValueError("a longer piece holds a line break")
        s = re.escape(alone)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{s}]*|[{s}]|[^{SPACE}{s}]+").findall
        self.words_in = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.decimal = [str(i) for i in range(lib.get_piece_size())]

        # Symbols: pieces by their ids, then characters that only occur within pieces. SELF is a character's own bytes.
        self.symbols = dict(self.ids)
        for c in sorted(inner - set(self.ids)):
            self.symbols[c] = lib.get_piece_size() + len(self.symbols) - len(self.ids)
        self.base = lib.get_piece_size() + len(self.symbols)
        self.rank = np.full(self.base + 1, NEVER, np.float32)
        for p, i in self.ids.items():
            self.rank[i] = self.costs[p]
        both = {self.symbols[p[:k]] * self.base + self.symbols[p[k:]]: i for p, i in self.ids.items() if len(p) > 1 for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols}
        self.pairs = Pairs(np.fromiter(both, np.int64, len(both)), np.fromiter(both.values(), np.int32, len(both)))
        codes = {ord(c): i for c, i in self.symbols.items() if len(c) == 1}
        self.codes = np.full(max(codes) + 2, -1, np.int64)
        self.codes[list(codes)] = list(codes.values())

        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line_break = self.merged("\n")
        self.opening = self.merged(SPACE) + self.line_break
        for probe in ("a", " a  b\t1\n", "Ab1é中\U0001f600 x"):
            self.compare(probe, self.text_ids(probe))

    # ------------------------------------------------------------ agendas

    def merged(self, part: str) -> list[int]:
        """The ids of one part, by a heap."""
        found, symbols = self.costs, list(part)
        n = len(symbols)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in found:
                agenda.append((found[pair], i, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, pair = pop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = pair + symbols[k]
                if both in found:
                    push(agenda, (found[both], i, both))
            h = before[i]
            if h >= 0:
                both = symbols[h] + pair
                if both in found:
                    push(agenda, (found[both], h, both))
        ids = []
        for s in symbols:
            if s is not None:
                got = self.ids.get(s)
                ids += [got] if got is not None else [self.bytes[b] for b in s.encode()]
        return ids

    def cost(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a pair costs and what it forms; NEVER and -1 where it is no piece."""
        made = self.pairs.get(left.astype(np.int64) * self.base + right)
        made[(left < 0) | (right < 0)] = -1
        return self.rank[made], made  # rank's last place is NEVER

    def rows_merged(self, parts: list[str]) -> list[bytes]:
        """The ids (int32) of parts of up to SHORT characters, whose agendas are rows of a matrix: in each round every row
        joins its best pair. A symbol stays at the place of its first character; after and before link the places."""
        n = len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, n)
        width = int(sizes.max())
        code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = np.full((n, width + 1), -2, np.int64)  # -2: nothing, -1: a character in no piece
        symbol[row, column] = self.codes[np.minimum(code, len(self.codes) - 1)]
        alive = np.zeros((n, width + 1), bool)
        alive[row, column] = True
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        flat = [x.reshape(-1) for x in (symbol, alive, after, before)]
        symbols, lives, afters, befores = flat
        costs, makes = self.cost(symbol[:, :-1].reshape(-1), symbol[:, 1:].reshape(-1))
        agenda, make = np.full((n, width + 1), NEVER, np.float32), np.full((n, width + 1), -1, np.int32)
        agenda[:, :-1], make[:, :-1] = costs.reshape(n, width), makes.reshape(n, width)
        agendas, making = agenda.reshape(-1), make.reshape(-1)
        wide = width + 1
        live = np.arange(n)
        while len(live):
            best = agenda[live].argmin(axis=1) if len(live) < n else agenda.argmin(axis=1)
            at = live * wide + best
            go = agendas[at] < NEVER
            live, at, best = live[go], at[go], best[go]
            start = live * wide
            j = start + afters[at]  # the right symbol, swallowed
            symbols[at] = making[at]
            lives[j] = False
            agendas[j] = NEVER
            k = afters[j]
            afters[at] = k
            inside = k < wide
            befores[(start + k)[inside]] = best[inside]
            right = np.where(inside, symbols[start + np.minimum(k, width)], -2)
            agendas[at], making[at] = self.cost(symbols[at], right)
            h = befores[at]
            left = np.flatnonzero(h >= 0)
            to = start[left] + h[left]
            agendas[to], making[to] = self.cost(symbols[to], symbols[at[left]])
        # Symbols that are pieces give their id; the others are single characters, spelt in bytes.
        where = np.flatnonzero(lives)
        ids, rows = symbols[where], where // wide
        spelt = np.flatnonzero((ids < 0) | (ids >= len(self.decimal)))
        if len(spelt):
            texts = [parts[r][c] for r, c in zip(rows[spelt].tolist(), (where[spelt] % wide).tolist())]
            lengths = np.ones(len(ids), np.int64)
            encoded = [t.encode() for t in texts]
            lengths[spelt] = [len(x) for x in encoded]
            ids, rows = np.repeat(ids, lengths), np.repeat(rows, lengths)
            starts = (np.cumsum(lengths) - lengths)[spelt]
            for s, x in zip(starts.tolist(), encoded):
                ids[s : s + len(x)] = [self.bytes[b] for b in x]
        data = ids.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(rows, minlength=n))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encoded(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of distinct parts, each compared with the library."""
        out: dict[str, bytes] = {}
        short = sorted((p for p in parts if len(p) <= SHORT), key=len)
        for a in range(0, len(short), ROWS):
            some = short[a : a + ROWS]
            out.update(zip(some, self.rows_merged(some)))
        for p in parts:
            if len(p) > SHORT:
                out[p] = np.array(self.merged(p), np.int32).tobytes()
        self.check(out)
        return out

    # ------------------------------------------------------------ checks

    def check(self, found: dict[str, bytes]) -> None:
        """Compare parts with the library, each behind a line break."""
        opening, between = np.array(self.opening, np.int32).tobytes(), np.array(self.line_break, np.int32).tobytes()
        parts = list(found)
        groups = [parts[a : a + COMPARED] for a in range(0, len(parts), COMPARED)]
        for group in groups:
            want = self.library.encode("\n" + "\n".join(group).replace(SPACE, " "))
            if opening + between.join(map(found.__getitem__, group)) != np.array(want, np.int32).tobytes():
                for part in group:
                    alone = self.library.encode("\n" + part.replace(SPACE, " "))[len(self.opening) :]
                    if alone != np.frombuffer(found[part], np.int32).tolist():
                        raise AssertionError(f"the library encodes {part!r} as {alone}, not {np.frombuffer(found[part], np.int32).tolist()}")
                raise AssertionError("the library encodes parts otherwise beside others than alone")

    def compare(self, text: str, ids: list[int]) -> None:
        want = self.library.encode(text)
        if want != ids:
            raise AssertionError(f"the library encodes {text[:60]!r} as {want[:20]}, not {ids[:20]}")

    # ------------------------------------------------------------ texts

    def split(self, text: str) -> list[str]:
        """The words of a text: what stands between two single spaces, or with a run of spaces before it in SPACE signs."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            marked = SPACE + text.replace(" ", SPACE)
            return [w[1:] if w[1:2] != SPACE else w for w in self.words_in(marked)]
        return text.split(" ")

    def text_ids(self, text: str) -> list[int]:
        return next(iter(self.encode([text])))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order. All words of the texts are looked up first, and the new ones encoded together."""
        if len(self.words) >= self.remembered:
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        split = [self.split(t) for t in texts]
        wanted: set[str] = set()
        for ws in split:
            wanted.update(ws)
        new = []
        for w in wanted.difference(words):
            got = old.get(w)
            if got is None:
                new.append(w)
            else:
                words[w] = got
        cut = {w: self.parts(w if w[:1] == SPACE else SPACE + w) for w in new if not w.isalpha()}
        fresh = {SPACE + w for w in new if w not in cut}
        for parts in cut.values():
            fresh.update(parts)
        found = self.encoded([*fresh])
        for w in new:
            parts = cut.get(w)
            words[w] = found[SPACE + w] if parts is None else b"".join([found[p] for p in parts])
        get = words.__getitem__
        for ws in split:
            yield np.frombuffer(b"".join(map(get, ws)), np.int32).tolist()
        for w in new:
            if len(w) > LONGEST:
                del words[w]

    def decoded(self, texts: list[str], ids: list[list[int]]) -> list[str]:
        """The library's decode(ids); every text has to be spelt by its ids, or have the library's ids."""
        got = self.library.decode(ids, num_threads=1)
        for text, back, own in zip(texts, got, ids):
            if back != text and back != text.replace(SPACE, " "):
                self.compare(text, own)
        return got


def agenda(model: bytes) -> Agenda:
    """The worker's encoder for these model bytes."""
    state, key = worker_state("pieces"), ("agenda", sha256(model).hexdigest())
    if key not in state:
        state[key] = Agenda(model)
    return state[key]


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", lists: bool = True, digests: bool = False) -> DataFrame:
    """Encode and decode every text: id and n_tokens; with lists ids array<int> and decoded string; with digests
    ids_sha256 (of the ids joined by commas) and decoded_sha256."""
    require(docs, id_col, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = "n_tokens long" + ", ids array<int>, decoded string" * lists + ", ids_sha256 string, decoded_sha256 string" * digests

    def fn(pairs):
        enc = agenda(shipped.value)
        decimal = enc.decimal.__getitem__
        for rows, column in pairs:
            texts = [x or "" for x in column.to_pylist()]
            counts, flat, sums, decoded, decoded_sums = [], [], [], [], []
            todo: list[list[int]] = []
            done = 0

            def decode():
                nonlocal done
                got = enc.decoded(texts[done : done + len(todo)], todo)
                if digests:
                    decoded_sums.extend(sha256(x.encode()).hexdigest() for x in got)
                if lists:
                    flat.append(np.concatenate([np.array(ids, np.int32) for ids in todo]))
                    decoded.extend(got)
                done += len(todo)
                todo.clear()

            for k, ids in enumerate(enc.encode(texts)):
                if k == 0:
                    enc.compare(texts[0], ids)
                counts.append(len(ids))
                if digests:
                    sums.append(sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                todo.append(ids)
                if len(todo) >= 64:
                    decode()
            if todo:
                decode()
            made = [pa.array(counts, pa.int64())]
            if lists:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                made += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))), pa.array(decoded, pa.string())]
            if digests:
                made += [pa.array(sums, pa.string()), pa.array(decoded_sums, pa.string())]
            yield rows, made

    return with_computed(docs, text_col, [id_col], fn, schema)
