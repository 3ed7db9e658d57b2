"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on all trusted text.

Trusted are documents labelled quality 1. Four of five of them, by a hash of doc_id, are counted, every one whole: the
counts of 5-grams by language are combined before and after one shuffle, and each lower order counts the different
characters before an n-gram. Probabilities come from count tables joined by (language, context) and (language, suffix).
A character beyond the first OWN_CLASSES code points is two symbols, a lead and a trail, so that characters of every
script are told apart.

The rest of the trusted documents set the thresholds: a document is rejected if its log perplexity lies above its
language's QUANTILE there by more than SLACK, widened for short texts by their standard error. As much is taken off the
costs that the quantile is of, but it is never below what all their characters cost on average, so that long texts are
measured fairly by short ones. A language with fewer than LEAST_HELD of them goes by the quantile over all languages.

Scoring looks the model up in shards of SHARD_ROWS rows about, each broadcast by itself: a shard holds all n-grams of
the same character before the last one, so each place in a text belongs to one shard, and the shards' sums of log
probabilities add up to the document's. The number of shards grows with the model; results don't depend on it.

Defined results: a null, empty or blank text has no perplexity and is rejected; a document whose language has no trusted
text is scored with the model that likes it best; with no trusted text at all, or none among the rest, nothing but blank
texts is rejected; rows that repeat stay rows of their own; an empty table gives an empty result; other columns come back
as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.workers import mapped

from .common import OWN, located, saved, text_of

ORDER, BITS = 5, 12
SHARD_ROWS = 3_000_000
QUANTILE, SLACK, SPREAD, LEAST_HELD = 0.98, 0.10, 2.0, 20
#: Symbols: code points below OWN_CLASSES are their own, above them are the leads of the others; 1 stands before a text's first character.
CLASSES, OWN_CLASSES, START = 1 << BITS, (1 << BITS) - 512, 1
#: n-grams that a task holds before it hands them on, and characters taken at once.
HELD, BATCH = 400_000, 1 << 18
#: Discounts where counts of counts are too few.
PLAIN = (0.5, 1.0, 1.5)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, ORDER - 1 starts before each; where each text begins (and the end)."""
    pad = chr(START) * (ORDER - 1)
    cp = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts)])
    far = cp >= OWN_CLASSES
    if not far.any():
        return cp, begin
    at = np.concatenate(([0], np.cumsum(1 + far)))
    out = np.empty(at[-1], np.int64)
    out[at[:-1]] = np.where(far, OWN_CLASSES + cp // OWN_CLASSES - 1, cp)
    out[at[1:][far] - 1] = cp[far] % OWN_CLASSES
    return out, at[begin]


def grams(cls: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at every character, as a number; the text of each."""
    key = np.zeros(max(0, len(cls) - ORDER + 1), np.int64)
    for k in range(ORDER):
        key = (key << BITS) | cls[k : k + len(key)]
    sizes = np.diff(begin) - ORDER + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(begin[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return key[first + np.arange(len(text))], text


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def counted(rows: DataFrame) -> DataFrame:
    """rows: lang, text. lang, g, n of every 5-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "g", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for l, t in zip(langs, texts, strict=True) if l == lang]
                for a, b in parts(own):
                    keys, n = np.unique(grams(*classes(own[a:b]))[0], return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
                    if size > HELD:
                        yield from out()
                        size = 0
        yield from out()

    return mapped(rows.select("lang", "text"), run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def low(column: str, order: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << BITS * order) - 1))


def discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """By language, what counts 1, 2 and 3 or more are lowered by."""
    of = counts.filter("n <= 4").groupBy("lang", "n").count().collect()  # four rows a language at most
    seen: dict[str, dict[int, int]] = {}
    for r in of:
        seen.setdefault(r.lang, {})[r.n] = r["count"]
    out = {}
    for lang, c in seen.items():
        if all(c.get(k, 0) > 0 for k in (1, 2, 3, 4)):
            y = c[1] / (c[1] + 2 * c[2])
            raw = [k - (k + 1) * y * c[k + 1] / c[k] for k in (1, 2, 3)]
            out[lang] = tuple(min(max(d, 0.05 * k), 0.98 * k) for k, d in zip((1, 2, 3), raw, strict=True))
    return out


def by_language(of: dict[str, tuple], k: int) -> Column:
    pairs = [x for lang, d in of.items() for x in (F.lit(lang), F.lit(d[k]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(PLAIN[k])) if pairs else F.lit(PLAIN[k])


def model(rows: DataFrame) -> DataFrame:
    """rows: lang, text. The model's rows: lang, level, key, value: level 1 to 5 log probabilities of n-grams, level -4 to -0 the log weights that contexts of that length leave to the shorter one."""
    counts = {ORDER: saved(counted(rows), "grams")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = saved(counts[k + 1].groupBy("lang", low("g", k).alias("g")).agg(F.count(F.lit(1)).alias("n")), "grams")
    lower, out = None, []
    for k in range(1, ORDER + 1):
        off = discounts(counts[k])
        d = [by_language(off, i) for i in range(3)]
        table = counts[k].withColumn("context", F.shiftright("g", BITS))
        sums = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), *[F.sum((F.col("n") == i).cast("long") if i < 3 else (F.col("n") >= 3).cast("long")).alias(f"n{i}") for i in (1, 2, 3)])
        left = (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")
        weights = sums.select("lang", "context", "total", left.alias("left"))
        joined = table.join(weights, ["lang", "context"])
        down = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        if lower is None:
            p = joined.withColumn("q", F.lit(1.0 / CLASSES))
        else:
            p = joined.withColumn("suffix", low("g", k - 1)).join(lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
        lower = saved(p.select("lang", "g", ((F.col("n") - down) / F.col("total") + F.col("left") * F.col("q")).alias("p")), "probabilities")
        out.append(lower.select("lang", F.lit(k).alias("level"), F.col("g").alias("key"), F.log("p").cast("float").alias("value")))
        out.append(weights.select("lang", F.lit(1 - k).alias("level"), F.col("context").alias("key"), F.log("left").cast("float").alias("value")))
    return saved(reduce(DataFrame.unionByName, out), "model")


class Table:
    """Numbers to values by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        while len(keys):
            at = self.find(keys)
            spot, one = np.unique(at, return_index=True)
            self.keys[spot], self.values[spot] = keys[one], values[one]
            keys, values = np.delete(keys, one), np.delete(values, one)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[at]
        open_ = np.nonzero((held != keys) & (held != -1))[0]
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return at

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none; which there are."""
        at = self.find(keys)
        return self.values[at], self.keys[at] == keys


class Shard:
    """A part of one language's model, and which places in a text it covers."""

    def __init__(self, level: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.grams = [Table(key[level == k], value[level == k]) for k in range(1, ORDER + 1)]
        self.weights = [Table(key[level == 1 - k], value[level == 1 - k]) for k in range(1, ORDER + 1)]

    def log_p(self, key: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(key)), np.arange(len(key))
        for k in range(ORDER, 0, -1):
            value, there = self.grams[k - 1].get(key[at] & (1 << BITS * k) - 1)
            out[at[there]] += value[there]
            at = at[~there]
            if not len(at):
                return out
            out[at] += self.weights[k - 1].get((key[at] & (1 << BITS * k) - 1) >> BITS)[0]
        out[at] -= np.log(CLASSES)
        return out


def place_of(lang: Column, before: Column, shards: int) -> Column:
    """The shard of the places after a character of this class."""
    return F.pmod(F.xxhash64(lang, before.cast("long")), F.lit(shards)).cast("int")


def sums(docs: DataFrame, whole: DataFrame, rows: int) -> DataFrame:
    """docs: key columns, lang, text. Key columns, model (language of the model), total (log probability), n (characters), for each model a document is scored with."""
    spark = docs.sparkSession
    shards = max(1, -(-rows // SHARD_ROWS))
    rest = [c for c in docs.columns if c not in ("lang", "text")]
    after = F.when(F.col("level") >= 2, F.shiftright("key", BITS)).otherwise(F.col("key")).bitwiseAND(F.lit(CLASSES - 1))
    # unigrams and the weight of the empty context are in every shard
    dealt = whole.withColumn("shard", F.when(F.col("level").isin(0, 1), F.lit(-1)).otherwise(place_of(F.col("lang"), after, shards)))
    known = {r.lang for r in whole.select("lang").distinct().collect()}
    places = {}
    if shards > 1:  # a row for each symbol
        of = spark.range(CLASSES).select("id", *[place_of(F.lit(lang), F.col("id"), shards) for lang in sorted(known)]).orderBy("id").collect()
        places = {lang: np.array([r[i + 1] for r in of]) for i, lang in enumerate(sorted(known))}
    found = None
    for s in range(shards):
        part = dealt.filter(F.col("shard").isin(-1, s)).select("lang", "level", "key", "value").toArrow()
        langs, level, key, value = (part.column(c).to_numpy() for c in ("lang", "level", "key", "value"))
        pick = {lang: of == s for lang, of in places.items()}
        shared = spark.sparkContext.broadcast((langs.astype(str), level, key, value, pick, sorted(known)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, level, key, value, pick, known = shared.value
            parsed = {lang: Shard(level[langs == lang], key[langs == lang], value[langs == lang]) for lang in known}
            for batch in batches:
                of, texts = batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist()
                rows, models, totals, sizes = [], [], [], []
                for lang in known:
                    own = [i for i, x in enumerate(of) if x == lang or x not in parsed]
                    picked = [texts[i] for i in own]
                    for a, b in parts(picked):
                        g, text = grams(*classes(picked[a:b]))
                        if pick:
                            here = pick[lang][g >> BITS & CLASSES - 1]
                            g, text = g[here], text[here]
                        totals.append(np.bincount(text, parsed[lang].log_p(g), b - a))
                        sizes.append(np.bincount(text, minlength=b - a))
                        rows += own[a:b]
                        models += [lang] * (b - a)
                taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(rest)]]
                flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
                yield pa.RecordBatch.from_arrays([*taken, pa.array(models, pa.string()), flat(totals, pa.float64()), flat(sizes, pa.int64())], [*rest, "model", "total", "n"])

        rows_ = docs.select(*rest, "lang", "text")
        one = mapped(rows_, run, rows_.drop("lang", "text").schema.add("model", "string").add("total", "double").add("n", "long"))
        found = one if found is None else found.unionByName(one)
    if shards > 1:
        found = found.groupBy(*rest, "model").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return found


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def scored(rows: DataFrame, labels: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    """rows, located. Place, doc_id, model, perplexity, n, threshold, kept."""
    place = [f"{OWN}file", f"{OWN}row"]
    base = rows.select(*place, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.trim(F.regexp_replace(text_of(text), r"\s+", " ")).alias("text"))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    # one plan at every size: ids of labelled rows grow with the input, so they are never broadcast
    trusted = base.filter("text != ''").join(good.hint("merge"), "doc_id")
    whole = model(trusted.filter(fold(F.col("doc_id")) != 0).select("lang", "text"))
    size = whole.count()
    if not size:
        return base.select(*place, "doc_id", F.col("lang").alias("model"), F.lit(None).cast("double").alias("perplexity"), F.length("text").cast("long").alias("n"), F.lit(None).cast("double").alias("threshold"), (F.col("text") != "").alias("kept"))
    all_sums = saved(sums(base, whole, size), "sums")
    rank = F.struct((F.col("total") / F.greatest("n", F.lit(1))).alias("mean"), "model", "total", "n")
    # a document of a language without a model has a row for each model: the best one counts
    best = all_sums.groupBy(*place, "doc_id").agg(F.max(rank).alias("b")) if not _own_models(base, whole) else all_sums.select(*place, "doc_id", rank.alias("b"))
    cost = F.when(F.col("b.n") > 0, -F.col("b.total") / F.greatest("b.n", F.lit(1)))
    each = best.select(*place, "doc_id", F.col("b.model").alias("model"), F.col("b.n").alias("n"), cost.alias("cost"))
    wide = F.lit(SPREAD) / F.sqrt(F.greatest("n", F.lit(1)))
    held = each.join(good, "doc_id").filter((fold(F.col("doc_id")) == 0) & F.col("cost").isNotNull())
    quantile = F.greatest(F.percentile_approx(F.col("cost") - wide, QUANTILE, 10000), F.sum(F.col("cost") * F.col("n")) / F.sum("n")).alias("q")
    limits = held.rollup("model").agg(quantile, F.count(F.lit(1)).alias("held"), F.grouping("model").alias("all")).collect()
    everywhere = next((r.q for r in limits if r["all"] == 1 and r.q is not None), None)
    pairs = [x for r in limits if r["all"] == 0 and r.held >= LEAST_HELD for x in (F.lit(r.model), F.lit(float(r.q) + SLACK))]
    pooled = F.lit(None if everywhere is None else float(everywhere) + SLACK).cast("double")
    limit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), pooled) if pairs else pooled
    return each.select(*place, "doc_id", "model", F.exp("cost").alias("perplexity"), "n", F.exp(limit + wide).alias("threshold"), F.coalesce(F.col("cost") <= limit + wide, F.col("n") > 0).alias("kept"))


def _own_models(base: DataFrame, whole: DataFrame) -> bool:
    return base.select("lang").distinct().join(whole.select("lang").distinct(), "lang", "left_anti").isEmpty()


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, model, perplexity, n, threshold, kept."""
    return scored(located(docs), labels, text, doc_id, lang).drop(f"{OWN}file", f"{OWN}row")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept."""
    rows, place = located(docs), [f"{OWN}file", f"{OWN}row"]
    gone = scored(rows, labels, text, doc_id, lang).filter(~F.col("kept")).select(*place)
    return rows.join(gone, place, "left_anti").select(*docs.columns)
