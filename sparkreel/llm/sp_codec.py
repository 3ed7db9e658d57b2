"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that aren't known yet, each once, form one text, whose suffix array is built as deep as the longest
piece. Binary search finds every piece's range of suffixes, that is, all its occurrences. Those are the edges of a
lattice over the text; sorted by position they are relaxed from left to right: an edge reaches its end if its piece is
stable beside the last piece before its start (see `bpe`), which exactly one edge into each place is. What is left,
read backwards from a word's end, is the library's encoding.

Words meet pieces only at their start (no piece holds a space after another character), so a text's ids are its words'
ids in turn. Characters in no piece are spelled in bytes. Whole texts are encoded, by batches of bounded size.

Defined results: a null text counts as empty and has no ids; decoding gives the text back, but that a literal U+2581
comes back as a space, as with the library; rows that repeat stay rows of their own; an empty table gives an empty
result; other columns come back as they were, but those named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sparkreel.workers import mapped

from .bpe import SPACE, WORD, Model
from .common import OWN, others, text_of
from .token_counts import model_bytes

#: Characters of text taken at once.
BATCH = 2 << 20
_encoders: dict[int, Encoder] = {}
_decoders: dict[int, Decoder] = {}


class PairTable:
    """Which pairs of pieces are stable, as an open-addressing table that is looked up for whole arrays. Emptied when half full."""

    SLOTS = 1 << 21

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys, self.kept, self.used = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it belongs."""
        mask = self.SLOTS - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64) & mask
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
            at[open_] = at[open_] + 1 & mask
        return at

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.model.size + b
        at = self.slots(keys)
        new = self.keys[at] == -1
        if new.any():
            fresh = np.unique(keys[new])
            if self.used + len(fresh) > self.SLOTS // 2:
                self.clear()
                fresh = np.unique(keys)
            if len(fresh) > self.SLOTS // 2:  # more pairs than the table is made for: no table
                known = np.fromiter((self.model.stable(*divmod(int(k), self.model.size)) for k in fresh), bool, len(fresh))
                return known[np.searchsorted(fresh, keys)]
            good = np.fromiter((self.model.stable(*divmod(k, self.model.size)) for k in fresh.tolist()), bool, len(fresh))
            self.model.forget()  # the table knows them now
            self.used += len(fresh)
            while len(fresh):  # of keys that belong in one place, one takes it and the rest look on
                slot, one = np.unique(self.slots(fresh), return_index=True)
                self.keys[slot], self.kept[slot] = fresh[one], good[one]
                fresh, good = np.delete(fresh, one), np.delete(good, one)
            at = self.slots(keys)
        return self.kept[at]


class Encoder:
    #: Words whose ids are remembered.
    WORDS = 150_000
    #: The last piece of a place that nothing constrains: a word's start, and what follows a character in no piece.
    FREE, UNKNOWN = -1, -2

    def __init__(self, model: Model):
        self.model, self.pairs = model, PairTable(model)
        self.known: dict[str, bytes] = {}
        self.order = sorted(model.ids)
        self.letters = {ord(c) for p in self.order for c in p}
        self.code_points = np.array(sorted(self.letters), np.int32)

    def packed(self, codes: np.ndarray, bits: int, depth: int) -> np.ndarray:
        """From every place, the next depth codes as one number; past the end there are zeros."""
        padded = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(np.uint64)
        key = np.zeros(len(codes), np.uint64)
        for k in range(depth):
            key = (key << np.uint64(bits)) | padded[k : k + len(codes)]
        return key

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece in text (code points, 0 between words): start, length, id."""
        alphabet = np.array(sorted(self.letters & set(np.unique(text).tolist())), np.int64)
        bits = 8 if len(alphabet) < 255 else 16
        depth = 64 // bits
        lookup = np.zeros(int(text.max(initial=0)) + 1, np.uint16)
        lookup[alphabet] = np.arange(1, len(alphabet) + 1)
        codes = lookup[text]
        code = {int(c): i + 1 for i, c in enumerate(alphabet)}
        pieces = [(p, i) for p, i in self.model.ids.items() if all(ord(c) in code for c in p)]
        if not pieces:
            return (np.zeros(0, np.int32),) * 3
        # the suffix array, as deep as one number; ranges that longer pieces need are sorted deeper below
        keys = self.packed(codes, bits, depth)
        array = np.argsort(keys).astype(np.int32)
        ranked = keys[array]
        del keys
        size = np.fromiter((len(p) for p, _ in pieces), np.int64, len(pieces))
        low = np.fromiter((sum(code[ord(c)] << bits * (depth - 1 - k) for k, c in enumerate(p[:depth])) for p, _ in pieces), np.uint64, len(pieces))
        free = np.maximum(0, depth - size) * bits
        high = low | np.where(free == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << free.astype(np.uint64)) - np.uint64(1))
        first, last = np.searchsorted(ranked, low, "left"), np.searchsorted(ranked, high, "right")
        starts, which = [], []
        for k in np.nonzero(last > first)[0].tolist():
            suffixes = array[first[k] : last[k]]
            for at in range(depth, int(size[k]), depth):  # the next characters of a longer piece
                rest = [code[ord(c)] for c in pieces[k][0][at : at + depth]]
                here = np.ones(len(suffixes), bool)
                for j, c in enumerate(rest):
                    spot = suffixes + at + j
                    here &= (spot < len(codes)) & (codes[np.minimum(spot, len(codes) - 1)] == c)
                suffixes = suffixes[here]
            starts.append(suffixes)
            which.append(np.full(len(suffixes), k, np.int32))
        if not starts:
            return (np.zeros(0, np.int32),) * 3
        start, k = np.concatenate(starts), np.concatenate(which)
        ids = np.fromiter((i for _, i in pieces), np.int32, len(pieces))
        return start, size.astype(np.int32)[k], ids[k]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (no empty ones), as int32 bytes."""
        text = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int32)
        start, length, piece = self.edges(text)
        base = np.repeat(begin, sizes + 1)
        # places whose character is in no piece: one edge that is always taken
        strange = np.ones(len(text), bool)
        strange[begin + sizes] = False
        strange = np.nonzero(strange & ~np.isin(text, self.code_points))[0].astype(np.int32)
        if len(strange):
            start, length, piece = np.concatenate([start, strange]), np.concatenate([length, np.ones(len(strange), np.int32)]), np.concatenate([piece, np.full(len(strange), self.UNKNOWN, np.int32)])
        offset = start - base[start]
        by = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
        start, length, piece, offset = start[by], length[by], piece[by], offset[by]
        # last[p]: the piece that ends at place p, as seen from the next one; back[p]: where it begins
        last, back = np.full(len(text) + 1, self.FREE, np.int32), np.full(len(text) + 1, -1, np.int32)
        cuts = np.searchsorted(offset, np.arange(int(offset[-1]) + 2)) if len(offset) else np.zeros(1, np.int64)
        for d in range(len(cuts) - 1):
            s, n, p = start[cuts[d] : cuts[d + 1]], length[cuts[d] : cuts[d + 1]], piece[cuts[d] : cuts[d + 1]]
            before = last[s]
            good = (before < 0) | (p < 0)
            ask = np.nonzero(~good)[0]
            if len(ask):
                good[ask] = self.pairs.stable(before[ask].astype(np.int64), p[ask].astype(np.int64))
            s, e, p = s[good], (s + n)[good], p[good]
            last[e], back[e] = p, s
        return self.read_back(words, text, begin, sizes, last, back)

    def read_back(self, words: list[str], text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        at, who = begin + sizes, np.arange(len(words))
        found, tokens = [], np.zeros(len(words), np.int64)
        while len(who):
            found.append((who, at, last[at]))
            tokens[who] += 1
            at = back[at]
            more = at > begin[who]
            at, who = at[more], who[more]
        ends = np.cumsum(tokens)
        ids, places = np.zeros(int(ends[-1]), np.int32), np.zeros(int(ends[-1]), np.int32)
        for step, (who, at, own) in enumerate(found):  # the step-th token from a word's end
            spot = ends[who] - 1 - step
            ids[spot], places[spot] = own, at
        if (ids == self.UNKNOWN).any():
            spelled = [[self.model.byte[b] for b in chr(int(text[a - 1])).encode("utf-8", "surrogatepass")] if i == self.UNKNOWN else [i] for a, i in zip(places.tolist(), ids.tolist(), strict=True)]
            tokens = np.add.reduceat(np.fromiter(map(len, spelled), np.int64, len(spelled)), np.concatenate(([0], ends[:-1])))
            ids, ends = np.fromiter((i for x in spelled for i in x), np.int32), np.cumsum(tokens)
        flat, cuts = ids.astype("<i4").tobytes(), (np.concatenate(([0], ends)) * 4).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > self.WORDS:
            self.known.clear()
        table = {w: b"" for ws in split for w in ws}
        new = []
        for w in table:
            ids = self.known.get(w)
            if ids is not None:
                table[w] = ids
            elif w[1:2] == SPACE or "\0" in w:  # pieces of spaces alone share one score: merged as the library does
                table[w] = np.array(self.model.ids_of(self.model.merge(list(w))), "<i4").tobytes()
            else:
                new.append(w)
        if new:
            table.update(zip(new, self.encode_words(new), strict=True))
            for w in new[: max(0, self.WORDS - len(self.known))]:
                if len(w) <= 32:
                    self.known[w] = table[w]
        return [np.frombuffer(b"".join([table[w] for w in ws]), "<i4") for ws in split]


class Decoder:
    def __init__(self, model: Model):
        self.parts = [model.pieces.get(i, "").replace(SPACE, " ").encode("utf-8", "surrogatepass") for i in range(model.size)]
        for b, i in enumerate(model.byte):
            self.parts[i] = bytes([b])

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, without the space put before the text."""
        return b"".join([self.parts[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def batches_of(sizes: list[int], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters (or bytes) in all, one text at least."""
    at = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def encoder_of(model: bytes) -> Encoder:
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Model(model))
    return _encoders[key]


def decoder_of(model: bytes) -> Decoder:
    key = hash(model)
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(Model(model))
    return _decoders[key]


def encode(docs: DataFrame, model: bytes | None = None, text: str = "text", to: str = "ids", round_trip: str | None = None) -> DataFrame:
    """docs with its text replaced by the ids of its pieces, an array<int> column named to.

    round_trip: name of a column more, whether decoding the ids gave the text again.
    """
    rest, file = others(docs, text, to, *([round_trip] if round_trip else [])), model or model_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder_of(file)
        back = Decoder(machine.model)
        for batch in batches:
            column = batch.column(len(rest))
            for a, b in batches_of(pc.binary_length(column).to_pylist()):
                texts = column.slice(a, b - a).to_pylist()
                ids = machine.encode(texts)
                ends = np.cumsum([0, *map(len, ids)])
                found = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))]
                if round_trip:
                    found.append(pa.array([back.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(rest)]), *found], names)

    names = [*rest, to, *([round_trip] if round_trip else [])]
    rows = docs.select(*rest, text_of(text).alias(f"{OWN}text"))
    schema = rows.drop(f"{OWN}text").schema.add(to, ArrayType(IntegerType()))
    return mapped(rows, run, schema.add(round_trip, "boolean") if round_trip else schema)


def decode(tokens: DataFrame, model: bytes | None = None, ids: str = "ids", to: str = "text") -> DataFrame:
    """tokens with its ids replaced by the text they stand for; null ids count as none."""
    rest, file = others(tokens, ids, to), model or model_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = decoder_of(file)
        for batch in batches:
            column = batch.column(len(rest))
            texts = [machine.decode(column[i].values.to_numpy(zero_copy_only=False).tolist()) if column[i].is_valid else "" for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, to])

    rows = tokens.select(*rest, F.col(ids).alias(f"{OWN}ids"))
    return mapped(rows, run, rows.drop(f"{OWN}ids").schema.add(to, "string"))
