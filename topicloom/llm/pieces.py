"""SentencePiece (BPE with byte fallback) encoding by a prefix table, and decoding.

A list of pieces is the encoding of a text exactly if each two neighbours are the encoding
of their own concatenation ("compatible"), and every prefix of a text has one encoding.
So each prefix has one last piece. One pass of an automaton over the text gives, for every
position, the pieces that end there; the one that is compatible with the last piece of the
prefix before it is stored. Reading the table backwards from the end gives the ids. The
time is linear in the text, whatever it holds.

Compatibility: merges happen in the order of their score, so each piece on the right edge
of the first piece's merge tree exists during a known span of merges, and so does each
piece on the left edge of the second one's. The two are incompatible if some two of these
exist together and their concatenation is a piece that is merged before either goes on.

No piece holds a blank after another character, so a text falls into units (blanks, then
what is no blank; a line feed alone) that are encoded one by one. Units seen before are
taken from a bounded table of the worker, which changes the speed only.

Defined results: null is the empty text, whose encoding is empty and decodes to the empty
text; rows that repeat are encoded one by one; further columns are not touched.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.base import query, table

BLANK = "▁"
UNITS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
START = -1
MOST_UNITS = 150_000  # units that a worker remembers
MOST_CHARS = 2_400_000  # and their characters, so long ones take no more room
MOST_PAIRS = 500_000  # pairs of pieces that a worker remembers
LONG_RUN = 64  # shorter runs are encoded many at a time, longer ones by themselves
ROWS = 128  # texts in one pass


class Trie:
    """The pieces as a trie over character classes; children are in a hashed table."""

    def __init__(self, words: dict[tuple[int, ...], int], n_classes: int):
        self.n_classes = n_classes
        children: dict[int, int] = {}
        piece = [-1]
        for word, i in words.items():
            node = 0
            for c in word:
                node = children.setdefault(node * n_classes + c, len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        self.children = Table(len(children))
        self.children.put(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int32, len(children)))
        self.root = np.zeros(n_classes, np.int64)
        for c in range(1, n_classes):
            self.root[c] = children.get(c, 0)

    def step(self, node: np.ndarray, classes: np.ndarray) -> np.ndarray:
        found = self.children.get(node * self.n_classes + classes).astype(np.int64)
        found[(found < 0) | (classes == 0)] = 0
        return found


class Table:
    """Whole numbers to small numbers, looked up many at a time; forgets all when full."""

    def __init__(self, room: int):
        bits = max(10, int(room * 4).bit_length())
        self.shift, self.mask, self.room = 64 - bits, (1 << bits) - 1, room
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        self.used, self.probes = 0, 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not in the table, each once."""
        if self.used + len(keys) > self.room:
            self.clear()
        held, size = self.keys, self.mask
        for key, value, slot in zip(keys[: self.room].tolist(), values.tolist(), self._slots(keys).tolist()):
            probes = 1
            while held[slot] != -1:
                slot = (slot + 1) & size
                probes += 1
            held[slot] = key
            self.values[slot] = value
            self.probes = max(self.probes, probes)
            self.used += 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for unknown keys."""
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], -1)
        rest = np.flatnonzero((out < 0) & (self.keys[slots] != -1) & (self.keys[slots] != keys))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            slots[rest] = (slots[rest] + 1) & self.mask
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[(held != -1) & ~hit]
        return out


class Units:
    """Ids of the units a worker has met, in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.chars, self.filled, self.stored = 0, 0, 0

    def has_room(self, units: list[str]) -> bool:
        return len(self.place) + len(units) <= MOST_UNITS and self.chars + sum(map(len, units)) <= MOST_CHARS

    def add(self, units: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` holds those of the units one behind the other, ``sizes`` of each."""
        first, total = len(self.place), len(ids)
        self.place.update(zip(units, range(first, first + len(units))))
        self.chars += sum(map(len, units))
        self.begin = _grown(self.begin, first + len(units))
        self.size = _grown(self.size, first + len(units))
        self.ids = _grown(self.ids, self.filled + total)
        self.size[first : first + len(units)] = sizes
        self.begin[first : first + len(units)] = self.filled + np.cumsum(sizes) - sizes
        self.ids[self.filled : self.filled + total] = ids
        self.filled += total


def _grown(array: np.ndarray, need: int) -> np.ndarray:
    if need <= len(array):
        return array
    out = np.zeros(max(1024, need, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Codec:
    def __init__(self, path: str):
        from ahocorasick import Automaton
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_file=path)
        n = self.size = p.get_piece_size()
        kept = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(p.is_byte, self.byte_ids)):
            raise ValueError("a model with byte fallback is needed")
        self.piece = {i: p.id_to_piece(i) for i in kept}
        self.id = {s: i for i, s in self.piece.items()}
        if any(BLANK in s.lstrip(BLANK) for s in self.id):
            raise ValueError("a model whose pieces have blanks at their start only is needed")
        self.alphabet = {c for s in self.id for c in s}
        # merge order: higher scores first; a single character is there from the start
        order = sorted((i for i in kept if len(self.piece[i]) > 1), key=lambda i: (-p.get_score(i), i))
        self.rank = dict.fromkeys(kept, -1) | {i: k for k, i in enumerate(order)}
        self.joined = {}
        for s, i in self.id.items():
            for cut in range(1, len(s)):
                left, right = self.id.get(s[:cut]), self.id.get(s[cut:])
                if left is not None and right is not None:
                    self.joined[left * n + right] = self.rank[i]
        self._find_splits(order)
        self.automaton = Automaton()
        for i, s in self.piece.items():
            if len(s) == 1 or i in self.split:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.separator = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in self.alphabet)
        letters = {c: k for k, c in enumerate(sorted(self.alphabet), 1)}
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in letters]] = list(letters.values())
        possible = (i for i in kept if len(self.piece[i]) == 1 or i in self.split)
        self.trie = Trie({tuple(letters[c] for c in self.piece[i]): i for i in possible}, len(letters) + 1)
        inside = re.escape("".join(sorted(self.alphabet)))
        self.parts = re.compile(f"([{inside}]+)|([^{inside}]+)")
        self.length = {i: len(s) for i, s in self.piece.items()}
        self.lengths = np.zeros(n, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.edges: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.known = Table(MOST_PAIRS)
        self.units = Units()
        for probe in ("", " ", "  a b ", "The, first line\né中☃ <s>", "aaaa  bbbb\t#1"):
            if self.encode(probe) != p.encode(probe):
                raise ValueError("this model normalises texts; one that keeps them as they are is needed")

    def _find_splits(self, order: list[int]) -> None:
        """The two pieces whose merge makes each piece; none for those no text can give."""
        self.split: dict[int, tuple[int, int]] = {}
        n, joined = self.size, self.joined
        at_rank = order
        for i in order:
            parts = [self.id.get(c) for c in self.piece[i]]
            if None in parts:
                continue
            last = None
            while len(parts) > 1:
                ranks = [joined.get(a * n + b, n) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == n:
                    break
                k = ranks.index(best)
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [at_rank[best]]
            if parts == [i] and last is not None:
                self.split[i] = last
        for i, (a, b) in self.split.items():
            if max(self.rank[a], self.rank[b]) >= self.rank[i]:
                raise ValueError("a model whose pieces score below their parts is needed")

    def _edge(self, i: int, side: int) -> tuple:
        """(piece, made at, used up at) along one edge of a piece's merge tree, whole piece first."""
        key = 2 * i + side
        found = self.edges.get(key)
        if found is None:
            steps, at, gone = [], i, 1 << 30
            while True:
                steps.append((at, self.rank[at], gone))
                if at not in self.split:
                    break
                gone, at = self.rank[at], self.split[at][side]
            found = self.edges[key] = tuple(steps)
        return found

    def compatible(self, a: int, b: int) -> bool:
        rights, lefts, n, joined = self._edge(a, 1), self._edge(b, 0), self.size, self.joined
        i = j = 0
        while i < len(rights) and j < len(lefts):
            x, x_made, x_gone = rights[i]
            y, y_made, y_gone = lefts[j]
            # of equal merges the left one is first
            if x_gone > y_made and y_gone >= x_made:
                rank = joined.get(x * n + y)
                if rank is not None and rank < x_gone and rank <= y_gone:
                    return False
            if x_made >= y_made:  # go back in time: the one made later was not there before
                if x_made == y_made:
                    # made by the same merge, the left one first: x is there while y's parts are
                    j += 1
                else:
                    i += 1
            else:
                j += 1
        return True

    def _table(self, text: str) -> list[int]:
        """The last piece of every prefix of one long run between two separators."""
        last = [START] + [0] * (len(text) - 1)
        fits, done = self.fits, -1
        for end, (piece, length) in self.automaton.iter(text):
            if end == done:  # this prefix has its piece
                continue
            before = last[end - length]
            if before == START or fits(before, piece):
                last[end] = piece
                done = end
        return last

    def fits(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.compatible(a, b)
        return found

    def _tables(self, classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The last piece of every prefix of many short runs at once.

        ``classes`` are characters as small numbers, 0 between runs; ``firsts`` says where
        the run of each character begins. The automaton starts at every character; then
        all runs take their next prefix together.
        """
        trie, size = self.trie, self.size
        begin = np.flatnonzero(classes)
        node = trie.root[classes[begin]]
        ends, pieces, lengths, depth = [], [], [], 1
        at = begin
        while len(at):
            piece = trie.piece[node]
            hit = piece >= 0
            ends.append(at[hit])
            pieces.append(piece[hit])
            lengths.append(np.full(len(ends[-1]), depth, np.int32))
            at = at + 1
            node = trie.step(node, classes[at])
            go = node > 0
            at, node = at[go], node[go]
            depth += 1
        ends, pieces, lengths = map(np.concatenate, (ends, pieces, lengths))
        place = ends - firsts[ends]
        order = np.argsort(place, kind="stable")
        ends, pieces, lengths = ends[order], pieces[order].astype(np.int64), lengths[order]
        last = np.full(len(classes), START, np.int64)
        bounds = np.searchsorted(place[order], np.arange(place.max() + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            end, piece = ends[lo:hi], pieces[lo:hi]
            before = last[end - lengths[lo:hi]]
            fits = before == START
            open_ = np.flatnonzero(~fits)
            if len(open_):
                fits[open_] = self._fit(before[open_] * size + piece[open_])
            last[end[fits]] = piece[fits]
        return last

    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of pairs (a * size + b), from the table of known ones."""
        found = self.known.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = np.unique(keys[new])
            values = np.fromiter((self.compatible(*divmod(k, self.size)) for k in fresh.tolist()), np.int8, len(fresh))
            self.known.put(fresh, values)
            found[new] = values[np.searchsorted(fresh, keys[new])]
        return found > 0

    def _encode_run(self, run: str) -> list[int]:
        """Ids of a run of characters of the alphabet."""
        sep, length = self.separator, self.length
        if len(run) < LONG_RUN:
            return self._encode_runs([run])[1].tolist()
        last = self._table(sep + run + sep)
        at, ids = len(run), []
        while last[at] != START:
            piece = last[at]
            ids.append(piece)
            at -= length[piece]
        ids.reverse()
        return ids

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each run has, all ids one behind the other) of short runs of characters of the alphabet."""
        sep = self.separator
        text = sep + sep.join(runs) + sep
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes + 1)
        firsts = np.repeat(ends - 1 - sizes, sizes + 1)
        last = self._tables(self.classes[codes], np.concatenate([[0], firsts]))
        # all runs are read backwards together, a piece a round
        at, run, met = ends - 1, np.arange(len(runs)), []
        while len(run):
            piece = last[at]
            go = piece != START
            run, piece = run[go], piece[go]
            at = at[go] - self.lengths[piece]
            met.append((run, piece))
        counts = np.zeros(len(runs), np.int64)
        for run, _ in met:
            counts[run] += 1
        ids = np.empty(counts.sum(), np.int32)
        place = np.cumsum(counts) - 1
        for run, piece in met:
            ids[place[run]] = piece
            place[run] -= 1
        return counts, ids

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each unit has, all ids one behind the other)."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        strange = np.concatenate([[0], np.cumsum(self.classes[codes] == 0)])
        chars = np.fromiter(map(len, units), np.int64, len(units))
        edge = np.concatenate([[0], np.cumsum(chars)])
        plain = (strange[edge[1:]] == strange[edge[:-1]]) & (chars < LONG_RUN)
        short = np.flatnonzero(plain)
        sizes, flat = self._encode_runs([units[i] for i in short.tolist()]) if len(short) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        if len(short) == len(units):
            return sizes, flat
        rest = np.flatnonzero(~plain)
        single = []
        for i in rest.tolist():
            ids: list[int] = []
            for known, unknown in self.parts.findall(units[i]):
                if known:
                    ids += self._encode_run(known)
                else:
                    ids += [self.byte_ids[b] for b in unknown.encode()]
            single.append(ids)
        counts = np.zeros(len(units), np.int64)
        counts[short], counts[rest] = sizes, list(map(len, single))
        out = np.empty(counts.sum(), np.int32)
        of_short = np.repeat(plain, counts)
        out[of_short] = flat
        out[~of_short] = np.fromiter(chain.from_iterable(single), np.int32, len(out) - len(flat))
        return counts, out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        split = [UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        store = self.units
        missing = [u for u in set().union(*split) if u not in store.place]
        if missing:
            if not store.has_room(missing):
                store.clear()
                missing = list(set().union(*split))
            store.add(missing, *self.encode_units(missing))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        place = np.fromiter(map(store.place.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        begin, size = store.begin[place], store.size[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = store.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return total[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32), ids

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(
    docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """The ``keep`` columns, then ids array<int> and decoded string. Map-only."""
    path = model or default_model()
    source = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        tool = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                offsets, ids = tool.encode_batch(part.column(part.num_columns - 1).to_pylist())
                flat, cuts = ids.tolist(), offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                     pa.array([tool.decode(flat[a:b]) for a, b in zip(cuts, cuts[1:])], pa.string())],
                    names=[*keep, "ids", "decoded"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, ids array<int>, decoded string")


def with_digests(encoded: DataFrame) -> DataFrame:
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    )


@query("op2_sentencepiece")
def sentencepiece(spark, sf):
    return with_digests(encode_documents(table(spark, sf, "documents"))).drop("ids", "decoded")
