"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares words, with their ends marked, by their common subsequences of four symbols, gaps allowed up to
REACH symbols and weighted down by DECAY for each symbol skipped; it is divided by what a word of its length has at
most, so it needs no word pairs. Case, accents and anything inserted between letters that isn't one are ignored, and
letters written apart are read as one word, so gapped and spelled-out insults keep most of their subsequences.

Training takes a bounded sample of labelled documents (SAMPLE rows a class, texts of LONGEST characters at most, chosen
by a hash of doc_id). Labels are of documents, and most sentences of a toxic one are clean, so the machine isn't trained
on whole sentences: a toxic document is represented by the words in it that are most toxic. These witnesses are chosen
and the machine is trained on words in turns. The machine is linear in the Nyström features of LANDMARKS
words, hence linear in the subsequences themselves: its weights fold into one table of subsequences, and whole texts
are scored by array look-ups. A document's score comes from its highest and third highest word by logistic regression.

Defined results: a null, empty or letterless text has the score of no evidence; rows that repeat stay rows of their own;
without training rows of both classes every score is 0; an empty table gives an empty result; other columns come back as
they were, but one named like the result gives way to it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.workers import mapped

from .common import OWN, others, text_of

#: Bounds of the training sample.
SAMPLE, LONGEST = 1500, 20_000
LANDMARKS, TURNS = 400, 4
DECAY, REACH, SYMBOLS = 0.6, 5, 48
#: Symbols: 0 ends words, then the letters a to z and these; other scripts share the last ones. DROP is passed over.
MORE = "àâäáçéèêëíîïñóöôúüûßœ"
DROP = 255
STEPS = [(a, b, c) for a in range(1, REACH) for b in range(1, REACH) for c in range(1, REACH) if a + b + c <= REACH]
#: Characters scored at once.
BATCH = 1 << 20
#: Of a word that isn't there.
NOTHING = -1.0


def _symbols() -> np.ndarray:
    """The symbol of every code point below 0x3000."""
    out = np.full(0x3000, DROP, np.uint8)
    for cp in range(0x3000):
        c = chr(cp).lower()[:1]
        plain = unicodedata.normalize("NFD", c)[:1]
        if chr(cp).isspace():
            out[cp] = 0
        elif c in MORE:
            out[cp] = 27 + MORE.index(c)
        elif c == "ÿ":  # how training writes the last symbol
            out[cp] = SYMBOLS - 1
        elif "a" <= plain <= "z":
            out[cp] = ord(plain) - 96
        elif c.isalpha():
            out[cp] = 27 + cp % (SYMBOLS - 27)
    return out


_TABLE = _symbols()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each word after a 0; where words begin (their 0); the text of each word."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cp = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(cp < 0x3000, _TABLE[np.minimum(cp, 0x2FFF)], 27 + cp % (SYMBOLS - 27)).astype(np.uint8)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ends = np.cumsum(sizes) - 1  # each text's closing space is kept as its word end
    kept = s != DROP
    s, text = s[kept], text[kept]
    if not len(s):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int32)
    del ends, cp
    # one 0 between words
    zero = s == 0
    kept = ~zero | np.concatenate(([False], ~zero[:-1]))
    s, text = s[kept], text[kept]
    s, text = np.concatenate(([0], s)).astype(np.uint8), np.concatenate((text[:1], text))
    at = np.nonzero(s == 0)[0]
    # letters that stand alone, one after another in a text, are one word
    size = np.diff(at) - 1
    if len(size) > 1:
        lone = (size[:-1] == 1) & (size[1:] == 1) & (text[at[:-2] + 1] == text[at[1:-1] + 1])
        kept = np.ones(len(s), bool)
        kept[at[1:-1][lone]] = False
        s, text = s[kept], text[kept]
        at = np.nonzero(s == 0)[0]
    begin = at[:-1]
    return s, begin, text[begin + 1] if len(begin) else np.zeros(0, np.int32)


def subsequences(s: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For every step pattern: its weight, and for every place the number of the subsequence that begins there, 0 where it would leave the word."""
    n = len(s)
    zeros = np.cumsum(s == 0, dtype=np.int32)
    wide = s.astype(np.int32)
    for a, b, c in STEPS:
        span = a + b + c
        out = np.zeros(n, np.int32)
        if n > span:
            m = n - span
            inside = zeros[span - 1 : n - 1] == zeros[:m]
            number = ((wide[:m] * SYMBOLS + wide[a : a + m]) * SYMBOLS + wide[a + b : a + b + m]) * SYMBOLS + wide[span : span + m]
            out[:m] = np.where(inside, number, 0)
        yield DECAY ** (span - 3), out


def most(size: np.ndarray) -> np.ndarray:
    """The norm of a word of this many letters whose subsequences all differ."""
    n = np.maximum(size + 2, 4)
    return np.sqrt(sum(DECAY ** (2 * (sum(p) - 3)) * np.maximum(n - sum(p), 0) for p in STEPS)).clip(1.0)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of plain words: row, subsequence and weight of every entry of their normalised features."""
    s, begin, _ = words_of(words)
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(s) - 1)))
    size = np.diff(np.append(begin, len(s) - 1)) - 1
    scale = 1 / most(size)
    rows, numbers, weights = [], [], []
    for weight, number in subsequences(s):
        at = np.nonzero(number)[0]
        rows.append(row[at])
        numbers.append(number[at])
        weights.append(weight * scale[row[at]])
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(weights)


@dataclass
class Machine:
    table: np.ndarray
    bias: float
    logistic: tuple[float, float, float]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Decision value and text of every word."""
        s, begin, text = words_of(texts)
        if not len(begin):
            return np.zeros(0), text
        total = np.zeros(len(s), np.float32)
        for weight, number in subsequences(s):
            total += np.float32(weight) * self.table[number]
        size = np.diff(np.append(begin, len(s) - 1)) - 1
        return np.add.reduceat(total, begin) / most(size) + self.bias, text

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Highest and third highest word of each text."""
        out = np.full((len(texts), 2), NOTHING)
        value, text = self.words(texts)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b - a > 3:
                top = np.partition(value[a:b], b - a - 3)[-3:]
                out[i] = top.max(), top.min()
            elif b > a:
                out[i] = value[a:b].max(), value[a:b].min() if b - a == 3 else NOTHING
        return np.maximum(out, -3.0)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.table.any():
            return np.zeros(len(texts))
        x = self.evidence(texts)
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-(a * x[:, 0] + b * x[:, 1] + c).clip(-30, 30)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 12) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, bias last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    before = np.zeros(0)
    for _ in range(steps):
        active = np.nonzero(y * (x @ w) < 1)[0]
        if len(active) == len(before) and (active == before).all():
            break
        before = active
        xa, c = x[active], cost[active]
        w = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, (xa * c[:, None]).T @ y[active])
    return w


def logistic(x: np.ndarray, y: np.ndarray, scale: np.ndarray, steps: int = 30) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        w -= np.linalg.solve(ridge + (x * (scale * (p * (1 - p) + 1e-6))[:, None]).T @ x, x.T @ (scale * (p - y)) + ridge @ w)
    return w


def plain_words(text: str) -> set[str]:
    s, begin, _ = words_of([text])
    flat = s.tobytes()
    ends = [*begin[1:].tolist(), len(flat) - 1]
    return {flat[a + 1 : b].translate(_LETTERS).decode("latin-1") for a, b in zip(begin.tolist(), ends, strict=True)}


_LETTERS = bytes([32, *range(97, 123), *MORE[:-1].encode("latin-1"), 0xFF, *range(SYMBOLS, 256)])


def stretched(word: str, rnd: np.random.Generator) -> str:
    """The word with a letter put into it."""
    at = int(rnd.integers(1, max(2, len(word))))
    return word[:at] + "etaoinsrhldx"[int(rnd.integers(12))] + word[at:]


def train(rows: list[tuple[str, int]], totals: tuple[int, int] | None = None, seed: int = 7) -> Machine:
    """rows: text and label of sampled documents. totals: labelled rows of class 0 and 1 that the sample stands for."""
    rnd = np.random.default_rng(seed)
    bags = [(plain_words(t), y) for t, y in rows]
    toxic, clean = [b for b, y in bags if y == 1 and b], [b for b, y in bags if y != 1 and b]
    if not toxic or not clean:
        return Machine(np.zeros(SYMBOLS**4, np.float32), NOTHING, (0.0, 0.0, 0.0))
    seen: dict[str, list[int]] = {}
    for group, k in ((toxic, 0), (clean, 1)):
        for bag in group:
            for w in bag:
                seen.setdefault(w, [0, 0])[k] += 1
    words = sorted(w for w in seen if len(w) >= 2)
    count = np.array([seen[w] for w in words], float).reshape(-1, 2)
    number = {w: i for i, w in enumerate(words)}
    # how far above chance a word is met in toxic documents
    share = len(toxic) / (len(toxic) + len(clean))
    surprise = (count[:, 0] - share * count.sum(1)) / np.sqrt(count.sum(1) * share * (1 - share))
    ranked = np.argsort(-surprise, kind="stable")
    pick = ranked[: LANDMARKS * 3 // 4]
    others = np.nonzero(count[:, 1] > 0)[0]
    some = lambda of, n: rnd.choice(of, min(len(of), n), replace=False)
    marks = np.unique(np.concatenate([pick, some(others, LANDMARKS - len(pick))]))

    # Nyström features of a word are its subsequences times project
    row, sub, weight = features([words[i] for i in marks])
    used = np.unique(sub)
    lookup = np.full(SYMBOLS**4, -1, np.int32)
    lookup[used] = np.arange(len(used))
    small = np.zeros((len(marks), len(used)))
    np.add.at(small, (row, lookup[sub]), weight)
    values, vectors = np.linalg.eigh(small @ small.T)
    good = values > 1e-6 * values.max()
    project = (small.T @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32)

    def mapped(plain: list[str]) -> np.ndarray:
        out = np.zeros((len(plain), project.shape[1]), np.float32)
        for at in range(0, len(plain), 2000):
            r, n, v = features(plain[at : at + 2000])
            col = lookup[n]
            r, col, v = r[col >= 0], col[col >= 0], v[col >= 0]
            dense = np.zeros((len(plain[at : at + 2000]), len(used)), np.float32)
            np.add.at(dense, (r, col), v)
            out[at : at + 2000] = dense @ project
        return out

    machine = Machine(np.zeros(SYMBOLS**4, np.float32), NOTHING, (0.0, 0.0, 0.0))
    clean_words = [words[i] for i in others]
    negative = {words[i] for i in some(others, 12_000)}
    chosen = [np.fromiter((number[w] for w in bag if w in number), np.int64) for bag in toxic]
    of_toxic = np.unique(np.concatenate(chosen))
    enough = (count[:, 0] + 0.5) / (count[:, 1] + 0.5) >= 3 * len(toxic) / len(clean)
    value = np.where(count[:, 0] >= min(3, 1 + len(toxic) // 20), surprise, -9.0)
    for turn in range(TURNS):
        # a toxic document's witnesses: its words of the highest value that clean documents have far less often
        best = [c[np.argsort(-value[c], kind="stable")[:3]] for c in chosen if len(c)]
        witness = np.unique(np.concatenate(best)) if best else np.zeros(0, np.int64)
        witness = witness[enough[witness] & (value[witness] > (0 if turn == 0 else -0.2))]
        if not len(witness):
            break
        positive = [words[i] for i in witness]
        positive += [stretched(w, rnd) for w in positive if len(w) >= 4]
        plain = positive + sorted(negative)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        w = svm(mapped(plain), y, np.where(y > 0, 800.0 / len(positive), 3200.0 / len(negative)))
        table = np.zeros(SYMBOLS**4, np.float32)
        table[used] = project @ w[:-1]
        machine = Machine(table, float(w[-1]), machine.logistic)
        value[of_toxic] = machine.words([" ".join(words[i] for i in of_toxic)])[0]
        # the clean words that it takes for toxic ones are negatives of the next turn
        hard = machine.words([" ".join(clean_words)])[0]
        negative |= {clean_words[i] for i in np.argsort(-hard, kind="stable")[:3000]}
    texts, labels = [t for t, _ in rows], np.array([y == 1 for _, y in rows], float)
    x = np.vstack([machine.evidence(texts[a:b]) for a, b in parts(texts)])
    totals = totals or (int((labels == 0).sum()), int(labels.sum()))
    scale = np.where(labels == 1, totals[1] / max(1, labels.sum()), totals[0] / max(1, (1 - labels).sum()))
    machine.logistic = tuple(logistic(x, labels, scale / scale.mean()).tolist())
    return machine


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH characters in all, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, longest: int = LONGEST) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """At most per_class rows of each class, by a hash of doc_id, none of them held out; and how many rows of each class there are."""
    spark = docs.sparkSession
    own = labels.filter(F.col("toxic").isin(0, 1) & F.coalesce(~held_out(), F.lit(False))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    totals = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    short = docs.filter(F.length("text") <= longest).select("doc_id").join(own, "doc_id")
    ids = [r for k in (0, 1) for r in short.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return [], (totals.get(0, 0), totals.get(1, 0))
    picked = F.broadcast(spark.createDataFrame(ids, own.schema).distinct())  # 2 * per_class rows at most
    rows = docs.filter(F.length("text") <= longest).select("doc_id", "text").join(picked, "doc_id").select("text", "toxic").limit(4 * per_class).collect()
    return sorted((r.text, r.toxic) for r in rows), (totals.get(0, 0), totals.get(1, 0))


def score(docs: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """docs with its text replaced by the score, a column named to."""
    rest = others(docs, text, to)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SYMBOLS**4 floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            for a, b in parts(texts):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(rest)]), pa.array(own.score(texts[a:b]), pa.float64())], [*rest, to])

    rows = docs.select(*rest, text_of(text).alias(f"{OWN}text"))
    return mapped(rows, run, rows.drop(f"{OWN}text").schema.add(to, "double"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    machine = train(*training_rows(docs, labels))
    return score(docs.select("doc_id", "text"), machine).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
