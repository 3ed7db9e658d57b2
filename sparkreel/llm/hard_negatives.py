"""Hard-negative mining by distributed radix selection.

Scores are integer inner products of integer vectors. Anchors are scored against all rows block by block: a block of
rows and a block of anchors meet in one task, whose memory the blocks bound, and no score outlives its task. The k best
rows of a window of scores are selected digit by digit: each pass counts, for every window, the scores of its rows by
their next digit (a histogram of each block down to its own kth score, summed by window), finds the digit that holds
the kth score and narrows the window to it. After the last digit the kth score itself is known, and only rows that reach
it are gathered; of rows that tie with it each block hands on k, the smallest by id, at most.

It is done twice: for each anchor over the rows of its label (positives), then for each anchor and positive over the other
rows whose scores lie between set shares of the positive's (hard negatives).

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; nor do those
whose squared length after scaling is 2 ** 62 or more, whose scores no long holds. A shorter vector counts as filled up with
zeros, an empty one scores zero with all. A null vec_id is never an anchor's; as positive or negative it loses ties. Rows
that repeat a vec_id are rows of their own: each anchor row has its own results, and an anchor row's other rows include
those that bear its vec_id. A positive score of zero admits negatives of zero, one below zero none. An empty table gives an
empty result; columns besides vec_id, embedding and label play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.workers import importable

from .common import OWN, located, saved

#: Components are scaled by SCALE and rounded down.
SCALE = 256
#: Rows and anchors of a block; anchors scored at once.
ROWS, ANCHORS, SLICE = 4096, 2048, 256
#: Bits of a digit, at most.
DIGIT = 12
PLACE = ["file", "row"]


def vectors(table: DataFrame) -> DataFrame:
    """file, row (where it stands, as numbers), id, label, v of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = located(table).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    own = rows.select(F.xxhash64(f"{OWN}file").alias("file"), F.col(f"{OWN}row").alias("row"), F.col("vec_id").cast("long").alias("id"), label_of().alias("label"), scaled.alias("v"))
    return own.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).filter(F.col("square") < 2.0**62)


def label_of() -> Column:
    """The label; where vec_id is divisible by 7, the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")


def matrix(column: pa.ChunkedArray, dims: int, kind: type) -> np.ndarray:
    """Lists as the rows of a matrix, short ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), kind)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Block:
    """Scores of a block of windows' anchors against a block of rows."""

    def __init__(self, rows: pa.Table, windows: pa.Table, dims: int, kind: type, same: bool):
        column = lambda t, c: t.column(c).to_numpy()
        self.same, self.kind = same, kind
        self.rows, self.label, self.place = matrix(rows.column("v"), dims, kind), column(rows, "label"), [column(rows, c) for c in PLACE]
        self.lo, self.hi = column(windows, "lo"), column(windows, "hi")
        _, first, self.of = np.unique(column(windows, "anchor"), return_index=True, return_inverse=True)
        self.anchors, self.own = matrix(windows.column("av").take(pa.array(first)), dims, kind), [column(windows, f"a{c}")[first] for c in ["label", *PLACE]]
        # windows of each anchor side by side
        order = np.argsort(self.of, kind="stable")
        counts = np.bincount(self.of, minlength=len(first))
        slot = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.slots = np.full((len(first), counts.max(initial=0)), -1)
        self.slots[self.of[order], slot] = order

    def entries(self):
        """(windows, rows, scores) of all scores that lie in their windows, some anchors at a time."""
        top = np.iinfo(np.int64)
        lo, hi = np.full(len(self.anchors), top.max), np.full(len(self.anchors), top.min)
        np.minimum.at(lo, self.of, self.lo)
        np.maximum.at(hi, self.of, self.hi)
        for at in range(0, len(self.anchors), SLICE):
            to = slice(at, at + SLICE)
            scores = self.anchors[to] @ self.rows.T
            label, *place = (x[to, None] for x in self.own)
            fit = (scores >= lo[to, None].astype(self.kind)) & (scores <= hi[to, None].astype(self.kind)) & ((label == self.label) == self.same)
            fit &= ~((place[0] == self.place[0]) & (place[1] == self.place[1]))
            a, row = np.nonzero(fit)
            score = scores[a, row].astype(np.int64)
            for slots in self.slots[to].T:
                window = slots[a]
                inside = (window >= 0) & (score >= self.lo[window]) & (score <= self.hi[window])
                yield window[inside], row[inside], score[inside]


def histogram(block: Block, windows: pa.Table, shift: int, width: int, offset: int) -> pa.Table:
    """wid, digit, n: how many scores of each window have this digit, from the highest down to where they are k."""
    size, want = 1 << width, windows.column("k").to_numpy()
    found = [(np.zeros(0, np.int64),) * 3]
    for window, _, score in block.entries():
        digit = ((score + offset) >> shift) & (size - 1)
        held, at = np.unique(window, return_inverse=True)
        counts = np.bincount(at * size + digit, minlength=len(held) * size).reshape(len(held), size)[:, ::-1]
        above = np.cumsum(counts, 1) - counts
        w, d = np.nonzero((counts > 0) & (above < want[held, None]))
        found.append((held[w], size - 1 - d, counts[w, d]))
    window, digit, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"wid": windows.column("wid").take(pa.array(window)), "digit": pa.array(digit, pa.int64()), "n": pa.array(n, pa.int64())})


def gathered(block: Block, rows: pa.Table, windows: pa.Table, k: int) -> pa.Table:
    """wid, id, file, row, score: what lies in the narrowed windows, k of each at most: the highest, then the smallest by id."""
    ids, place = rows.column("id"), block.place
    order = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    w, r, s = ([np.zeros(0, np.int64)] for _ in range(3))
    for window, row, score in block.entries():
        best = np.lexsort((order[row], -score, window))
        window, row, score = window[best], row[best], score[best]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        for x, own in ((w, window), (r, row), (s, score)):
            x.append(own[rank < k])
    w, r, s = (np.concatenate(x) for x in (w, r, s))
    return pa.table({"wid": windows.column("wid").take(pa.array(w)), "id": ids.take(pa.array(r)), "file": place[0][r], "row": place[1][r], "score": s})


class Scorer:
    """Rows in blocks, to be scored against windows of anchors."""

    def __init__(self, rows: DataFrame, block: int, anchors: int):
        self.spark, self.rows, self.anchors = rows.sparkSession, rows, anchors
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max("square").alias("square")).head()
        self.n, self.dims, self.most = facts.n, facts.dims or 0, int(facts.square or 0)
        self.bits = self.most.bit_length() + 1  # no score lies beyond the greatest squared length
        self.kind = np.float32 if self.most < 1 << 24 else np.float64 if self.most < 1 << 53 else np.int64
        self.type = "array<smallint>" if self.most < 1 << 28 else "array<int>" if self.most < 1 << 60 else "array<bigint>"
        self.blocks = max(1, -(-self.n // block))

    def scored(self, windows: DataFrame, n_anchors: int, same: bool, run, schema: str) -> DataFrame:
        """run(block, rows, windows) for every block of rows and every block of windows' anchors."""
        importable(self.spark)
        dims, kind, blocks, cuts = self.dims, self.kind, self.blocks, max(1, -(-n_anchors // self.anchors))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        tasks = min(blocks * cuts, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        left = self.rows.select(*PLACE, "id", "label", F.col("v").cast(self.type).alias("v"), F.pmod(F.xxhash64(*PLACE), F.lit(blocks)).cast("int").alias("i"), spread(cuts).alias("j")).repartition(tasks, "i", "j")
        right = windows.withColumns({"av": F.col("av").cast(self.type), "i": spread(blocks), "j": F.pmod(F.xxhash64("anchor"), F.lit(cuts)).cast("int")}).repartition(tasks, "i", "j")

        def met(rows: pa.Table, windows: pa.Table) -> pa.Table:
            rows, windows = rows.combine_chunks(), windows.combine_chunks()
            return run(Block(rows, windows, dims, kind, same), rows, windows)

        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(met, schema)

    def best(self, windows: DataFrame, n_anchors: int, k: int, same: bool) -> DataFrame:
        """windows: wid, anchor (its number), av, alabel, afile, arow, lo, hi. Of each, the k highest scores between lo and hi: wid, id, file, row, score, rank (from 1)."""
        digits = -(-self.bits // DIGIT)
        width, offset = -(-self.bits // digits), 1 << (self.bits - 1)
        # once all that is left of a window is less than k, it is open: whatever it held at first is gathered
        live = windows.withColumns({"floor": F.col("lo"), "top": F.col("hi"), "k": F.lit(k).cast("long"), "open": F.lit(False)})
        for i in range(digits):
            shift = width * (digits - 1 - i)
            counts = self.scored(live.filter("not open and lo <= hi"), n_anchors, same, lambda block, rows, wins, shift=shift: histogram(block, wins, shift, width, offset), "wid long, digit long, n long").groupBy("wid", "digit").agg(F.sum("n").alias("n"))
            live = saved(narrowed(live, counts, shift, width, offset), "windows")
        ends = live.select("wid", "anchor", "av", "alabel", "afile", "arow", F.when(F.col("open"), F.col("floor")).otherwise(F.col("lo")).alias("lo"), F.col("top").alias("hi")).filter("lo <= hi")
        rows = self.scored(ends, n_anchors, same, lambda block, rows, wins: gathered(block, rows, wins, k), "wid long, id long, file long, row long, score long")
        rank = F.row_number().over(Window.partitionBy("wid").orderBy(F.desc("score"), F.asc_nulls_last("id"), *PLACE))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def narrowed(live: DataFrame, counts: DataFrame, shift: int, width: int, offset: int) -> DataFrame:
    """Windows cut to the digit that holds the kth score; k is what is wanted of that digit."""
    down = Window.partitionBy("wid").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("upto", F.sum("n").over(down)).join(live.select("wid", "k"), "wid")
    found = reached.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select("wid", "digit", (F.col("k") - F.col("upto") + F.col("n")).alias("left"))
    # windows agree on all digits above this one, but in the first pass, where there is none above
    above = F.shiftleft(F.shiftright(F.col("lo") + offset, shift + width), shift + width) if shift + width < 63 else F.lit(0).cast("long")
    least = above + F.shiftleft(F.col("digit"), shift) - offset
    cut = F.col("digit").isNotNull()
    return live.join(found, "wid", "left").withColumns({
        "lo": F.when(cut, F.greatest("lo", least)).otherwise(F.col("lo")), "hi": F.when(cut, F.least("hi", least + (1 << shift) - 1)).otherwise(F.col("hi")),
        "k": F.coalesce("left", "k"), "open": F.col("open") | ~cut,
    }).drop("digit", "left")


def mine(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by every. A negative's score lies between least and most per cent of its positive's.
    """
    rows = saved(vectors(table), "vectors")
    scorer = Scorer(rows, block, anchors)
    own = saved(rows.filter(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), F.col("v").alias("av"), *(F.col(c).alias(f"a{c}") for c in ["label", *PLACE])), "anchors")
    n = own.count()
    whole = own.withColumns({"wid": F.col("anchor"), "lo": F.lit(-scorer.most).cast("long"), "hi": F.lit(scorer.most).cast("long")})
    near = scorer.best(whole.drop("anchor_id"), n, positives, True)
    pairs = saved(near.select(F.monotonically_increasing_id().alias("wid"), F.col("wid").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    # least * score <= 100 * x <= most * score in whole numbers, without leaving the range of long; below zero nothing fits
    bounds = {"lo": F.ceil(score.cast("decimal(20,0)") * least / 100).cast("long"), "hi": F.floor(score.cast("decimal(20,0)") * most / 100).cast("long")}
    windows = pairs.filter(score >= 0).join(own, "anchor").withColumns(bounds)
    hard = scorer.best(windows.drop("anchor_id", "positive_id", "positive_score"), n, negatives, False)
    named = pairs.join(own.select("anchor", "anchor_id"), "anchor")
    return hard.join(named, "wid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
