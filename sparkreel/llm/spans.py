"""Global removal of repeated runs of units (sentences, lines) inside documents by DataFrame operations.

Each document becomes an array of units. Every run of consecutive units is hashed (128 bits), runs are grouped by hash
with map-side combining, and each occurrence but the first, by (doc_id, place of the row, position), marks its units as
covered; the occurrences of a run that is very frequent are dealt out over many tasks. Covered positions are merged for
each row, so overlapping runs remove a unit once. Rows are told apart by where they are stored, never by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, joined_by, located, saved

#: What ends a sentence, in the scripts that mark it.
ENDS = ".!?。！？…؟۔।"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences_of(text: Column) -> Column:
    """Pieces that joined give the text again: up to and with the closing ENDS or line ends."""
    return F.regexp_extract_all(text, F.lit(rf"([^{ENDS}\n]+[{ENDS}\n]*|[{ENDS}\n]+)"), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns worked out once a row. Without the generator between, Catalyst would write an expression into every lambda that reads it, to be worked out again for each element."""
    own = f"{OWN}once"
    return df.withColumn(own, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select(*df.columns, *[F.col(f"{own}.{n}").alias(n) for n in columns])


def runs(units: str, width: int) -> Column:
    """Every run of width units of the array column as struct(pos, size, key); none where there are fewer units."""
    starts = F.when(F.size(units) >= width, F.sequence(F.lit(0), F.size(units) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("size"), F.unhex(F.md5(F.array_join(F.slice(units, i + 1, width), "\n").cast("binary"))).alias("key")))


#: What tells rows apart, whatever their doc_id: the file, as a number, and the row in it.
PLACE = [f"{OWN}place", f"{OWN}row"]


def placed(docs: DataFrame) -> DataFrame:
    """docs with PLACE."""
    rows = located(docs)
    return rows.withColumn(PLACE[0], F.xxhash64(f"{OWN}file")).drop(f"{OWN}file")


def repeated(windows: DataFrame) -> DataFrame:
    """windows: PLACE, doc_id, pos, size, key (what runs of equal units share). For each row that loses units: PLACE, covered (sorted positions), kept_in (documents of the first occurrences; a null among them last)."""
    # counted and compared by plain columns, which needs no sort; a null doc_id comes first
    counts = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none")).filter("n > 1")
    met = saved(joined_by(windows, saved(counts, "repeats"), "key").withColumn("own", F.when(F.col("none"), F.col("doc_id").isNull()).otherwise(F.col("doc_id").eqNullSafe(F.col("least")))), "met")
    # of the rows of the first doc_id, few but where it repeats, the first by place
    first = met.filter("own").groupBy("key").agg(F.max("n").alias("n"), F.min(F.struct("doc_id", *PLACE, "pos")).alias("first"))
    later = joined_by(met.select("key", *PLACE, "pos", "size"), saved(first, "firsts"), "key").filter(" or ".join(f"first.{c} != {c}" for c in [*PLACE, "pos"]))
    found = later.groupBy(*PLACE).agg(F.collect_list(F.struct("pos", "size")).alias("runs"), F.array_sort(F.collect_set("first.doc_id")).alias("kept_in"), F.max(F.col("first.doc_id").isNull()).alias("no_id"))
    units = F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["size"] - 1)))
    kept_in = F.when(F.col("no_id"), F.array_append("kept_in", F.lit(None))).otherwise(F.col("kept_in"))
    return found.select(*PLACE, F.array_sort(F.array_distinct(units)).alias("covered"), kept_in.alias("kept_in"))


def report(rows: DataFrame, gone: DataFrame, units: Column, text: Column, separator: str, own: str) -> DataFrame:
    """rows (with PLACE) and the columns own + units (how many before), covered (removed positions or null), kept_in, clean (the text that is left)."""
    gone = gone.select(*PLACE, F.col("covered").alias(f"{own}covered"), F.col("kept_in").alias(f"{own}kept_in"))
    joined = rows.join(gone, PLACE, "left").drop(*PLACE).withColumn(f"{own}text", text)
    n = F.size(units)
    left = F.when(F.col(f"{own}covered").isNull(), F.lit(None)).otherwise(F.array_except(F.sequence(F.lit(0), n - 1), F.col(f"{own}covered")))
    cut = once(joined, **{f"{own}all": units, f"{own}left": left})
    clean = F.array_join(F.transform(f"{own}left", lambda i: F.get(F.col(f"{own}all"), i)), separator)
    return cut.withColumns({f"{own}units": F.size(f"{own}all"), f"{own}clean": F.when(F.col(f"{own}covered").isNull(), F.col(f"{own}text")).otherwise(clean)}).drop(f"{own}all", f"{own}left", f"{own}text")
