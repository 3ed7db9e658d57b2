"""A SentencePiece BPE model compiled: merges, which neighbours are stable, and a transducer that counts tokens.

The library merges, over and over, the adjacent pair whose joined piece scores highest, leftmost first. A sequence of
pieces is what it ends with exactly when each two neighbours, merged on their own, stay as they are. So the encoding of
a prefix grows by the one piece that ends there and is stable beside the last piece before it, and a machine that reads
characters from left to right needs only the pieces that may still end: finitely many states.
"""

from __future__ import annotations

import heapq
import re

import sentencepiece

SPACE = "▁"


class Model:
    """Pieces, scores and merges. model: the bytes of a .model file."""

    #: Pairs whose stability is remembered.
    PAIRS = 1 << 20

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sp, self.size = sp, sp.get_piece_size()
        plain = [i for i in range(self.size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.pieces.items()}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self._stable: dict[tuple[int, int], bool] = {}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or sp.encode(f"a  b{SPACE}\n", out_type=str)[0] != f"{SPACE}a":
            raise ValueError("pieces must hold spaces only at their start, and texts get a space before them")

    def merge(self, symbols: list[str]) -> list[str]:
        """The library's result for adjacent symbols, by a heap of pairs."""
        n = len(symbols)
        part, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, b, len(part[a]) + len(part[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not part[a] or not part[b] or right[a] != b or len(part[a]) + len(part[b]) != size:
                continue
            part[a], part[b] = part[a] + part[b], ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def stable(self, a: int, b: int) -> bool:
        """Whether pieces a and b, side by side, stay as they are."""
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) >= self.PAIRS:
                self._stable.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self._stable[a, b] = self.merge(list(x + y)) == [x, y]
        return known

    def forget(self) -> None:
        """Lets go of remembered pairs."""
        self._stable.clear()

    def ids_of(self, parts: list[str]) -> list[int]:
        """Ids of merged parts; a character that is no piece is spelled in bytes."""
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out


class Counter:
    """The transducer: transitions carry the change in the number of tokens, and are built when first taken.

    A state lists what may still end: the trie nodes of the pieces begun, each with the piece before its start and the
    number of tokens up to there, relative to the number now. Tables are emptied when they reach their bounds, so memory
    stays bounded; states are then built again.
    """

    STATES, WORDS = 150_000, 400_000

    def __init__(self, model: Model):
        self.model = model
        self.child: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        for piece, i in model.ids.items():
            at = 0
            for c in piece:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                at = self.child[at][c]
            self.end[at] = i
        self.words = Words(self)
        #: Whether a line end is in no piece: then it is a token of its own, and words on its sides are apart.
        self.line_ends = not any("\n" in p for p in model.ids)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.start = self.state(((0, -1, 0),))

    def state(self, entries: tuple) -> int:
        at = self.states.get(entries)
        if at is None:
            at = self.states[entries] = len(self.entries)
            self.entries.append(entries)
            self.next.append({})
        return at

    def step(self, at: int, c: str) -> tuple[int, int]:
        """The transition of state at by character c, built now."""
        if c not in self.child[0]:  # no piece holds it: bytes, and nothing merges across
            move = self.start, len(c.encode("utf-8", "surrogatepass"))
        else:
            last, count, live = -1, 0, []
            for node, before, n in self.entries[at]:
                to = self.child[node].get(c)
                if to is None:
                    continue
                piece = self.end[to]
                if piece >= 0 and (before < 0 or self.model.stable(before, piece)):
                    if last >= 0:
                        raise AssertionError("two pieces end here")
                    last, count = piece, n + 1
                if self.child[to]:
                    live.append((to, before, n))
            if last < 0:
                raise AssertionError("no piece ends here")
            move = self.state((*((node, before, n - count) for node, before, n in live), (0, last, 0))), count
        self.next[at][c] = move
        return move

    def run(self, symbols: str) -> int:
        at, total, table = self.start, 0, self.next
        for c in symbols:
            move = table[at].get(c) or self.step(at, c)
            at = move[0]
            total += move[1]
        return total

    def word(self, symbols: str) -> int:
        """Tokens of one word: spaces at its start only. From the start state to it again: one transition of a coarser machine, remembered."""
        return self.words[symbols]


class Words(dict):
    """Tokens by word, worked out when first asked for."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, symbols: str) -> int:
        counter = self.counter
        if len(counter.entries) > counter.STATES:
            counter.reset()
        if len(self) > counter.WORDS:
            self.clear()
        if counter.line_ends and "\n" in symbols:
            parts = symbols.split("\n")
            return sum(self[x] if x else 0 for x in parts) + len(parts) - 1
        if symbols[1:2] == SPACE:  # pieces of spaces alone share one score: ties go leftmost, which stability doesn't tell
            n = len(counter.model.ids_of(counter.model.merge(list(symbols))))
        else:
            n = counter.run(symbols)
        if len(symbols) <= 64:
            self[symbols] = n
        return n


class Map:
    """What a chunk of symbols does to the machine, whatever state it is entered in.

    head is read from the entering state; at the first word that begins inside the chunk the state is the start state
    again, so count, the tokens of the whole words after it, doesn't depend on where the chunk was entered; tail is the
    word begun, the state that is handed on. Without such a word the chunk is all head. `then` is associative, so maps
    of chunks compose in any grouping.
    """

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: str, count: int = 0, tail: str | None = None):
        self.head, self.count, self.tail = head, count, tail

    def then(self, other: Map, counter: Counter) -> Map:
        if self.tail is None:
            # a word may begin where the chunks meet
            cut = self.head[-1:] not in ("", SPACE) and other.head[:1] == SPACE
            return Map(self.head, other.count, None).closed(other, counter) if cut else Map(self.head + other.head, other.count, other.tail)
        if self.tail[-1:] != SPACE and other.head[:1] == SPACE:  # the word begun ends here
            count, begun = self.count + counter.word(self.tail), other.head
        else:
            count, begun = self.count, self.tail + other.head
        if other.tail is None:
            return Map(self.head, count, begun)
        return Map(self.head, count + counter.word(begun) + other.count, other.tail)

    def closed(self, other: Map, counter: Counter) -> Map:
        """self is all head and other begins a word."""
        if other.tail is None:
            return Map(self.head, 0, other.head)
        return Map(self.head, counter.word(other.head) + other.count, other.tail)

    def total(self, counter: Counter) -> int:
        return (counter.word(self.head) if self.head else 0) + self.count + (counter.word(self.tail) if self.tail else 0)


WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def chunk_map(symbols: str, counter: Counter) -> Map:
    words = WORD.findall(symbols)
    if len(words) < 2:
        return Map(symbols)
    return Map(words[0], sum(map(counter.words.__getitem__, words[1:-1])), words[-1])


def scan(maps: list[Map], counter: Counter) -> Map:
    """All maps composed, pair by pair: log2 n rounds, each of which may run in parallel."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1], counter) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(text: str, counter: Counter, chunk: int = 1 << 16) -> int:
    """The tokens of a whole text, by chunks."""
    if not text:
        return 0
    symbols = SPACE + text.replace(" ", SPACE)
    if len(symbols) <= chunk:
        return chunk_map(symbols, counter).total(counter)
    return scan([chunk_map(symbols[i : i + chunk], counter) for i in range(0, len(symbols), chunk)], counter).total(counter)
