"""MinHash near-dedup by one-permutation hashing, with stars of candidates instead of pairs.

A document's set holds the 64-bit hashes of its different three-word shingles, in order. That order is the one
permutation: the range of hashes is cut into BINS equal bins, and a bin's minimum is found by binary search in the sorted
set. An empty bin takes the value of the first bin that isn't empty along a random walk of its own, the same for every
document (optimal densification), so that any bin of two sets agrees with a chance of their Jaccard similarity, however
small they are. ROWS bins make a band; sets that share a band's value meet in its bucket.

Only different sets are indexed, so a group of copies counts once. A bucket of n sets hands on n - 1 candidates, a star
around its smallest member, and each is confirmed on the full sets. Where a bucket's members aren't all brought together
by confirmed links, those outside its main component are compared with the rest, in chunks dealt out by key, so no link
that a bucket holds is lost. A pair at exactly 0.85 shares no bucket with a chance of (1 - 0.85 ** 8) ** 40 = 3e-6, a closer
one less.

Defined results: a null or blank text has no shingle, is linked with nothing and stays; a text of fewer words than a
shingle has its whole word sequence as one; rows that repeat a doc_id are rows of their own, and a link of one counts for
its own component only; a null doc_id names no component unless all its rows have none, and such rows then share a null
component_id and stay; an empty table gives an empty result; very long texts are read whole; columns that docs has besides
doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkreel.workers import mapped

from .common import OWN, joined_by, located, saved
from .components import connected_components
from .simhash import BLOCK, other_links, shingle_hashes, verified, words_of

SHINGLE, SIMILARITY = 3, 0.85
BANDS, ROWS = 40, 8
BINS = BANDS * ROWS
#: Where the bins begin in the range of hashes.
STARTS = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
#: Steps of the bins' walks made at once.
STRIDE = 64


@cache
def walks(stride: int) -> np.ndarray:
    """Of every bin, the bins that it looks into at the steps of this stride."""
    return np.random.default_rng((42, stride)).integers(0, BINS, (BINS, STRIDE))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    parts = list(shingle_hashes(words_of(text), size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each bin, empty bins filled. shingles: sorted, at least one."""
    at = np.searchsorted(shingles, STARTS)
    full = np.diff(at, append=len(shingles)) > 0
    least = shingles[np.minimum(at, len(shingles) - 1)]
    empty, stride = np.nonzero(~full)[0], 0
    while len(empty):
        steps = walks(stride)[empty]
        met = full[steps]
        first = met.argmax(1)
        found = met[np.arange(len(empty)), first]
        least[empty[found]] = least[steps[found, first[found]]]
        empty, stride = empty[~found], stride + 1
    return least


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A number for each band; none without shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    rows = signature(shingles).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), i) for i, x in enumerate(rows)], np.uint64).view(np.int64)


def with_bands(docs: DataFrame, text: str) -> DataFrame:
    """docs' other columns, node (the digest of the text's set), k (its size) and bands."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for x in batch.column(len(rest)):
                own = shingle_set(x.as_py())
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                bands.append(bands_of(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], [*rest, "node", "k", "bands"])

    rows = docs.select(*rest, F.col(text).cast("string").alias(text))
    return mapped(rows, run, rows.drop(text).schema.add("node", "binary").add("k", "long").add("bands", ArrayType(LongType())))


def with_shingles(docs: DataFrame, text: str) -> DataFrame:
    """node, shingles: the set itself, eight bytes a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["node", "shingles"])

    return mapped(docs.select("node", F.col(text).cast("string").alias(text)), run, "node binary, shingles binary")


def stars(shared: DataFrame, similarity: float) -> DataFrame:
    """Candidates a, b: every member of a bucket with its smallest. Sets whose sizes alone rule the similarity out are left."""
    centers = shared.filter("node = first").select("key", F.col("k").alias("ka"))
    met = shared.filter("node != first").join(centers, "key")
    fits = F.least("k", "ka") >= similarity * F.greatest("k", "ka") - 1e-9
    return met.filter(fits).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def classify(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id its links reach), kept (it bears its component's name)."""
    rows = located(docs)
    place = [f"{OWN}file", f"{OWN}row"]
    slim = rows.select(*place, F.col(doc_id).alias("doc_id"), F.col(text).alias(f"{OWN}text"))
    prints = saved(with_bands(slim, f"{OWN}text"), "prints")
    every = prints.filter("k > 0").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.first("k").alias("k"), F.first("bands").alias("bands"), F.min(F.struct(*place)).alias("where"))
    nodes = saved(every, "nodes")
    keyed = nodes.select("node", "k", F.posexplode("bands").alias("band", "v")).select("node", "k", F.xxhash64("band", "v").alias("key")).repartition("key")
    # first, which holds for every row, keeps node in what is counted, so that counting and joining share one exchange
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    shared = saved(keyed.join(sizes, "key").filter(F.col("node") >= F.col("first")), "shared")
    met = shared.select("node").distinct().join(nodes, "node").select("node", *(F.col("where")[c].alias(c) for c in place))
    sets = saved(with_shingles(slim.join(met, place), f"{OWN}text"), "sets")
    links = saved(verified(stars(shared, similarity), sets, similarity), "links")
    first = connected_components(links)
    more = other_links(shared, first, sets, similarity, block)
    of = connected_components(saved(links.unionByName(more), "links"))
    rooted = nodes.join(of, "node", "left").select("node", "n", "least", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(rooted.join(names, "root").select("node", "n", "component_id"), "named")
    own = ["doc_id", F.col("k").alias("n_shingles")]
    linked = joined_by(prints.filter("k > 0").select("doc_id", "node", "k"), named, "node").select(*own, "component_id")
    alone = prints.filter("k = 0").select(*own, F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
