"""Benchmark decontamination by template canonicalisation: DataFrame operations only.

Texts become lower-case words; 1,250 and 7.5 are one number each. There are two templates of them. In both, numbers and
units after numbers are typed placeholders; in the second, so is every capitalised word, as a name. So a copy in other
letter case is found by the first, a question asked again about others by the second. Windows of WIDTH template words
are hashed; the documents' windows meet the benchmark's by equality join. Matched windows are compared word by word, with
their values beside them.

A window that has the item's own values counts wherever it stands. One that differs in values counts only with others of
its alignment (item against document): their slots must be consistent, equal benchmark values standing for equal document
values and the other way round, and there must be WINDOWS of them, or as many as the item has. A window of which over
half are placeholders, and the one window of an item of fewer than WIDTH words, says too little without its values: it is
literal, found with its own values only. No item is too short to count.

The benchmark's windows are broadcast only where their counted bytes are within MOST_BROADCAST, else the joins shuffle.

Defined results: null texts count as empty and never match, nor do texts without words; rows that repeat a doc_id, or
have none, are documents of their own, told apart by where they are stored, each with its own matches; repeated items are
reported each; an empty table on either side gives no matches; extra columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import OWN, saved, text_of

WIDTH, WINDOWS, MOST_BROADCAST = 8, 2, 64 << 20
#: Units of measure and money, as words.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "oz", "lb", "lbs", "pound", "pounds", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "ms", "sec", "second", "seconds", "min", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent",
    "mph", "kph", "hz", "khz", "mhz", "w", "kw", "v", "kb", "mb", "gb", "tb",
)
MARK, POINT = "\x01", "\x02"
NAME, NUMBER, UNIT = "<name>", "<number>", "<unit>"


def values_text(text: Column) -> Column:
    """The words of a text in lower case, a space between them; a capitalised one begins with MARK, a decimal point is POINT."""
    marked = F.regexp_replace(F.translate(text, MARK + POINT, "  "), r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}])", MARK)
    numbers = F.regexp_replace(F.regexp_replace(F.lower(marked), r"(?<=[0-9]),(?=[0-9])", ""), r"(?<=[0-9])\.(?=[0-9])", POINT)
    plain = F.regexp_replace(numbers, rf"[^\p{{L}}\p{{N}}{MARK}{POINT}]+", " ")
    return F.trim(F.regexp_replace(plain, r"(\p{N})(?=\p{L})", "$1 "))


def template_text(values: Column) -> Column:
    """Its numbers and units as placeholders, word by word."""
    numbered = F.regexp_replace(values, rf"(?<![^ ])[0-9]+(?:{POINT}[0-9]+)*(?![^ ])", NUMBER)
    return F.regexp_replace(numbered, rf"{NUMBER} {MARK}?(?:{'|'.join(UNITS)})(?![^ ])", f"{NUMBER} {UNIT}")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def unnamed(template: Column) -> Column:
    return F.translate(template, MARK, "")


def named(template: Column) -> Column:
    return F.regexp_replace(template, rf"{MARK}[^ ]+", NAME)


def paired(hashes: str, other: str, step: int) -> Column:
    """A hash of each element of an array column and the one of another that stands step places on."""
    n = F.greatest(F.size(other) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(other, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def worded(df: DataFrame, text: str) -> DataFrame:
    """df with its text replaced by v (values), t0 and t1 (templates), arrays of the same length."""
    rest = [c for c in df.columns if c != text]
    valued = spans.once(df, p=values_text(text_of(text))).select(*rest, "p")
    both = spans.once(valued, t=template_text(F.col("p")))
    return spans.once(both, v=words(unnamed(F.col("p"))), t0=words(unnamed(F.col("t"))), t1=words(named(F.col("t")))).select(*rest, "v", "t0", "t1")


def hashed(df: DataFrame, t0: Column, t1: Column, sizes: list[int]) -> DataFrame:
    """df's columns, pos, size, h of every window of these sizes, either template; where the two are alike, once.

    A window's hash is put together from hashes of halves, so that each is worked out once, not once a window.
    """
    level, names = spans.once(df, **{f"{OWN}0_1": F.transform(t0, lambda w: F.xxhash64(w)), f"{OWN}1_1": F.transform(t1, lambda w: F.xxhash64(w))}), list(df.columns)
    whole, size = [1], 1
    while 2 * size <= max(sizes, default=0):
        level = spans.once(level, **{f"{OWN}{t}_{2 * size}": paired(f"{OWN}{t}_{size}", f"{OWN}{t}_{size}", size) for t in (0, 1)})
        size *= 2
        whole.append(size)
    made = set(whole)
    for n in sizes:
        built = 0
        for part in (p for p in reversed(whole) if n & p):
            if built and built + part not in made:
                level = spans.once(level, **{f"{OWN}{t}_{built + part}": paired(f"{OWN}{t}_{built}", f"{OWN}{t}_{part}", built) for t in (0, 1)})
                made.add(built + part)
            built += part
    found = None
    for n in sizes:
        own = level.select(*names, F.posexplode(F.arrays_zip(F.col(f"{OWN}0_{n}").alias("a"), F.col(f"{OWN}1_{n}").alias("b"))).alias("pos", "w"))
        both = own.select(*names, "pos", F.lit(n).alias("size"), F.explode(F.when(F.col("w.a") == F.col("w.b"), F.array("w.a")).otherwise(F.array("w.a", "w.b"))).alias("h"))
        found = both if found is None else found.unionByName(both)
    return found


WINDOW = "item_id long, h long, at int, size int, words array<string>, values array<string>, literal boolean, least int"


def item_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """item_id, h, at, size, words (of the template), values, literal, least (windows that a match with other values needs) of every different window of an item; the sizes there are (width at most)."""
    spark = benchmark.sparkSession
    items = saved(worded(benchmark.select("item_id", F.col("text").alias("text")), "text").filter(F.size("v") > 0), "items")
    own = F.least(F.size("v"), F.lit(width))
    sizes = sorted(r.n for r in items.select(own.alias("n")).distinct().collect())
    if not sizes:
        return spark.createDataFrame([], WINDOW), []
    cut = lambda c: F.slice(F.col(c), F.col("pos") + 1, F.col("size"))
    found = None
    for n in sizes:
        fit = items.filter(own == n)
        for t in ("t0", "t1"):
            each = hashed(fit, F.col(t), F.col(t), [n])
            windows = each.select("item_id", "h", F.col("pos").alias("at"), "size", cut(t).alias("words"), cut("v").alias("values"), F.least(F.size("v") - F.col("size") + 1, F.lit(WINDOWS)).alias("least"))
            found = windows if found is None else found.unionByName(windows)
    plain = F.size(F.filter("words", lambda w: ~w.isin(NAME, NUMBER, UNIT)))
    kept = found.withColumn("literal", (2 * plain < F.col("size")) | (F.col("size") < width))
    # a literal window stands for its own values only, so each of its values counts
    unlike = kept.groupBy("item_id", "h", "size", "literal", "least", "words", F.when(F.col("literal"), F.col("values")).alias("as"))
    out = unlike.agg(F.min(F.struct("at", "values")).alias("w")).select("item_id", "h", "w.at", "size", "words", "w.values", "literal", "least")
    return saved(out, "windows"), sizes


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, item_id, n_windows (places of the document that match), reparameterised (whether any slot's value differs)."""
    return matches_placed(spans.placed(docs), benchmark, text=text, doc_id=doc_id, **options).drop(*spans.PLACE)


def matches_placed(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", most: int = MOST_BROADCAST) -> DataFrame:
    """docs: with spans.PLACE. The same, with each row's place."""
    bench, sizes = item_windows(benchmark, width)
    own = [*spans.PLACE, "doc_id"]
    size = F.sum(F.octet_length(F.array_join("words", "  ")) + F.octet_length(F.array_join("values", "  ")) + 200)
    side = F.broadcast if (bench.agg(size.alias("n")).head().n or 0) <= most else lambda x: x
    base = docs.select(*spans.PLACE, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not sizes:
        return base.join(bench, F.lit(False)).select(*own, "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(False).alias("reparameterised"))
    template = spans.once(base, t=template_text(values_text(text_of("text")))).select(*spans.PLACE, "t")
    each = hashed(template, words(unnamed(F.col("t"))), words(named(F.col("t"))), sizes)
    hits = each.select(*spans.PLACE, "pos", "size", "h").join(side(bench.select("h", "size").distinct()), ["h", "size"])
    # back to the texts, a row a document: only those that matched are cut into words with their values
    spots = hits.groupBy(*spans.PLACE).agg(F.collect_set(F.struct("pos", "size", "h")).alias("spots"))
    hit = worded(base.join(spots, spans.PLACE), "text")
    cut = lambda s, c: F.slice(F.col(c), s["pos"] + 1, s["size"])
    met = hit.select(*own, F.inline(F.transform("spots", lambda s: F.struct(s["pos"].alias("pos"), s["h"].alias("h"), cut(s, "t0").alias("t0"), cut(s, "t1").alias("t1"), cut(s, "v").alias("v")))))
    spotted = saved(met.distinct(), "spotted")  # both kinds of windows are looked for in it
    alike = (F.col("words") == F.col("t0")) | (F.col("words") == F.col("t1"))
    free = spotted.join(side(bench.filter(~F.col("literal"))), "h").filter(alike)
    # joined on the values too: a window of numbers meets those with its own numbers, not every one
    literal = spotted.join(side(bench.filter("literal").withColumnRenamed("values", "v")), ["h", "v"]).filter(alike)
    same = free.unionByName(literal.withColumn("values", F.col("v")))
    slot = F.filter(F.arrays_zip("words", "values", "v"), lambda s: s["words"].isin(NAME, NUMBER, UNIT))
    aligned = same.select(*own, "item_id", "least", "pos", (F.col("pos") - F.col("at")).alias("shift"), slot.alias("slots"), (F.col("values") == F.col("v")).alias("own"))
    byshift = aligned.groupBy(*own, "item_id", "least", "shift").agg(
        F.count_distinct("pos").alias("n"), F.count_distinct(F.when(F.col("own"), F.col("pos"))).alias("exact"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")
    )

    def distinct(side: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["words"], s[side]))))

    consistent = (distinct("values") == F.size("slots")) & (distinct("v") == F.size("slots")) & (F.col("n") >= F.col("least"))
    counted = byshift.select(*own, "item_id", F.when(consistent, F.col("n")).otherwise(F.col("exact")).alias("n"), (consistent & F.exists("slots", lambda s: s["values"] != s["v"])).alias("differ")).filter("n > 0")
    return counted.groupBy(*own, "item_id").agg(F.sum("n").alias("n_windows"), F.max("differ").alias("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that match no item."""
    rows = spans.placed(docs)
    found = matches_placed(rows, benchmark, text=text, doc_id=doc_id, **options).select(*spans.PLACE).distinct()
    return rows.join(found, spans.PLACE, "left_anti").select(*docs.columns)
