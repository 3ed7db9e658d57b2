"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits, few enough that fingerprints of up to three differing bits
agree in one of them but for a bit at most. Each segment is indexed once for every bit left out (a wildcard);
fingerprints that share such a variant meet by equality join and are verified on their whole distance. So every pair is
found.

Only different fingerprints are indexed, so a group of copies counts once. A bucket hands on a spanning forest of its
links, never its pairs. The fingerprints of buckets that hold over BLOCK of them are indexed on the whole instead, once
for every choice of `distance` bits left out: what shares such a variant differs in those bits alone, so it is within
distance without being compared, and a bucket holds 2 ** distance fingerprints at most. That makes C(64, distance) rows of
a fingerprint (2,016 at 2), however many there are. Components are joined in `components`.

near_dedup() takes the same steps with the fingerprints of sets of five-word shingles: variants, join, distance, then the
sets themselves compared exactly. At similarity 0.8 fingerprints lie about ten bits apart, too far for segments: what they
leave apart is looked for once more by bands of minima over the sets, whose chance to meet depends on the similarity alone,
wherever the words differ: 0.9993 at 0.8, more above. Of what meets there, all that fingerprints haven't joined is
compared by its sets: first every node of a bucket with the bucket's first, then, where that leaves a bucket in several
components, all that aren't joined yet.

Defined results: a null or blank text has the fingerprint zero and is linked like any other; a text of fewer words than
a shingle hashes its whole word sequence; a null identifier never names a component unless all its rows have none; an
empty table gives an empty result; extra columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkreel.workers import importable, mapped

from .common import OWN, joined_by, located, saved
from .components import connected_components

BLOCK = 1024
SEGMENT = 32
#: Shingles hashed at once.
PART = 1 << 16
#: Nodes of buckets compared at once.
HELD = 20_000
BIT = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of all shingles, repeats included."""
    if not words:
        return
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, PART):
        to = min(at + PART, len(words) - size + 1)
        yield np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)), np.uint64, to - at)


def fingerprint(words: list[bytes], size: int) -> int:
    """The fingerprint of all shingles, repeats included."""
    return majority(shingle_hashes(words, size))


def majority(parts: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for part in parts:
        n += len(part)
        ones += np.concatenate([np.bincount(x, minlength=256) @ BIT for x in part.view(np.uint8).reshape(-1, 8).T])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True) if n else 0


def words_of(text: str | None) -> list[bytes]:
    """Of the text with A-Z in lower case, what stands between characters of [\\x20\\x09-\\x0D]; bytes methods know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def with_print(docs: DataFrame, size: int, text: str) -> DataFrame:
    """docs' other columns and node, the 64 bits of the fingerprint as a number with a sign."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([fingerprint(words_of(x.as_py()), size) for x in batch.column(len(rest))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], nodes], [*rest, "node"])

    rows = docs.select(*rest, F.col(text).cast("string").alias(text))
    return mapped(rows, run, rows.drop(text).schema.add("node", "long"))


def forest(stack: np.ndarray, distance: int) -> np.ndarray:
    """stack: buckets x members. For every member the place of the smallest member of its bucket that links reach."""
    bare = stack.view(np.uint64)  # of a number with a sign, the bits of its absolute value would be counted
    near = np.bitwise_count(bare[:, :, None] ^ bare[:, None, :]) <= distance
    m = stack.shape[1]
    label = np.broadcast_to(np.arange(m), stack.shape).copy()
    while True:
        new = np.where(near, label[:, None, :], m).min(-1)
        if (new == label).all():
            return label
        label = new


def bucket_links(groups: DataFrame, distance: int) -> DataFrame:
    """groups: members (arrays of nodes, BLOCK at most). Links a, b of a spanning forest."""

    def linked(column: pa.ListArray) -> pa.RecordBatch:
        values, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(sizes).tolist():
            of = np.nonzero(sizes == m)[0]
            step = max(1, (1 << 18) // (m * m))
            for at in range(0, len(of), step):
                stack = values[first[of[at : at + step], None] + np.arange(m)]
                label = forest(stack, distance)
                g, k = np.nonzero(label != np.arange(m))
                a.append(stack[g, k])
                b.append(stack[g, label[g, k]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            # few nodes at once: a batch is counted in buckets, which may be large
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
                yield linked(column.slice(at, to - at))
                at = to

    # in order, so that buckets with much the same members hang them on the same one, and links repeat
    return mapped(groups.select(F.sort_array("members").alias("members")), run, "a long, b long")


def bits(choices: list[int]) -> int:
    """Their bits, as a number with a sign."""
    return int.from_bytes(sum(1 << i for i in choices).to_bytes(8, "little"), "little", signed=True)


def segment_variants(nodes: DataFrame) -> DataFrame:
    """key (a segment without one of its bits), node, for both segments and every bit."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bits([x for x in range(i // SEGMENT * SEGMENT, i // SEGMENT * SEGMENT + SEGMENT) if x != i])).cast("long").alias("mask")) for i in range(64)])
    return nodes.select("node", F.explode(each).alias("e")).select(F.col("e.i").alias("i"), F.col("node").bitwiseAND(F.col("e.mask")).alias("value"), "node")


def dense_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links a, b between all nodes within distance: they are the same once some `distance` bits are left out, whatever their number."""
    masks = F.array(*[F.lit(~bits(list(c))).cast("long") for c in combinations(range(64), distance)])
    each = nodes.select("node", F.posexplode(masks).alias("i", "mask")).select("i", F.col("node").bitwiseAND(F.col("mask")).alias("value"), "node")
    # 2 ** distance members at most
    met = each.groupBy("i", "value").agg(F.min("node").alias("b"), F.collect_list("node").alias("members")).filter(F.size("members") > 1)
    return met.select(F.explode("members").alias("a"), "b").filter("a != b")


def links(nodes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """nodes: node, all different. Links a, b that join all that are within distance (3 at most: one of two segments then holds a single differing bit at most)."""
    if not 1 <= distance <= 3:
        raise ValueError(f"two segments with a wildcard each find distances of 1 to 3, not {distance}")
    # nodes are few bytes and many variants: dealt out evenly before they multiply. None is null, and Spark should know: a test for it would part the plans that share an exchange
    spread = nodes.select(F.coalesce("node", F.lit(0).cast("long")).alias("node")).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    dealt = segment_variants(spread).repartition("i", "value")
    # least, which holds for every row, keeps node in what is counted, so that counting and joining share one exchange
    sizes = dealt.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    shared = saved(dealt.join(sizes, ["i", "value"]).filter(F.col("node") >= F.col("least")).select("i", "value", "node", "n"), "shared")
    groups = shared.filter(F.col("n") <= block).groupBy("i", "value").agg(F.collect_list("node").alias("members"))
    found = bucket_links(groups, distance)
    dense = shared.filter(F.col("n") > block).select("node").distinct()
    return found if dense.isEmpty() else found.unionByName(dense_links(saved(dense, "dense"), distance))


def components(fingerprints: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """fingerprints: rows with node. Gives node, root for every different node."""
    nodes = saved(fingerprints.select("node").distinct(), "nodes")
    edges = saved(links(nodes, distance, block).distinct(), "links")
    found = connected_components(edges)
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def classify(docs: DataFrame, shingle: int = 3, distance: int = 2, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, node (its 64-bit fingerprint, as a number with a sign), component_id (the smallest doc_id its links reach)."""
    prints = saved(with_print(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(f"{OWN}text")), shingle, f"{OWN}text"), "prints")
    of = components(prints, distance, block)
    least = prints.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).join(of, "node")
    root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(least.join(root, "root").select("node", "n", "component_id"), "named")
    return joined_by(prints, named, "node").select("doc_id", "node", "component_id")


#: Of near_dedup(): words of a shingle; bands and the minima in each. A pair at 0.8 meets with a chance of 1 - (1 - 0.8 ** 6) ** 24 = 0.9993.
SHINGLE, BANDS, MINIMA = 5, 24, 6
#: Bits by which fingerprints differ that meet by their variants. Three would make 41,664 variants of a crowded one, two make 2,016.
NEAR = 2
MIXED = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * MINIMA), np.uint64)
#: Shingles mixed at once; hashes of sets in a chunk of a bucket.
MIX, HASHES = 1 << 10, 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    parts = list(shingle_hashes(words_of(text), SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A number for each band: what BANDS times MINIMA mixed orders of all hashes have as the set's smallest."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), MIX):
        np.minimum(least, (shingles[at : at + MIX, None] * (MIXED[0] | np.uint64(1)) + MIXED[1]).min(0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, MINIMA))], np.uint64).view(np.int64)


def with_bands(docs: DataFrame, text: str) -> DataFrame:
    """docs' other columns, node (the digest of the text's set of shingles), k (how many there are), print (the set's fingerprint) and bands."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(len(rest))]
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            bands = pa.array([bands_of(x) for x in sets], pa.list_(pa.int64()))
            sizes, prints = (pa.array([of(x) for x in sets], pa.int64()) for of in (len, lambda x: majority([x])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], nodes, sizes, prints, bands], [*rest, "node", "k", "print", "bands"])

    rows = docs.select(*rest, F.col(text).cast("string").alias(text))
    return mapped(rows, run, rows.drop(text).schema.add("node", "binary").add("k", "long").add("print", "long").add("bands", ArrayType(LongType())))


def with_shingles(docs: DataFrame, text: str) -> DataFrame:
    """node, shingles: the set itself, eight bytes a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["node", "shingles"])

    return mapped(docs.select("node", F.col(text).cast("string").alias(text)), run, "node binary, shingles binary")


def close(shared: np.ndarray | int, m: np.ndarray | int, n: int, similarity: float) -> np.ndarray | bool:
    """Whether sets of m and n that share so many have this Jaccard similarity; two empty ones are alike."""
    return shared >= similarity * (m + n - shared) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets of shingles have this Jaccard similarity."""
    ends = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(bool(close(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "sa", "sb"), run, "a binary, b binary")


def joining(roots: list, minor: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places of pairs of this similarity, at least one end minor, that join components not joined yet. Every such pair is compared unless it is joined already."""
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends, owner, found = np.cumsum(sizes), np.repeat(np.arange(len(sets)), sizes), []
    for u in np.nonzero(minor)[0].tolist():
        if (root == root[u]).all():
            break
        mark = np.zeros(len(values), bool)
        mark[flat[ends[u] - sizes[u] : ends[u]]] = True
        shared = np.bincount(owner, mark[flat], len(sets))
        near = close(shared, sizes, int(sizes[u]), similarity)
        while (left := np.nonzero(near & (root != root[u]))[0]).size:
            found.append((u, int(left[0])))
            root[root == root[left[0]]] = root[u]
    return found


def other_links(shared: DataFrame, first: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links a, b between members of a bucket that its first node's links (components in first: node, root) haven't brought together.

    Minor nodes, those that aren't joined to the bucket's first, are compared with all its members. Both are dealt out in
    chunks of about block nodes and HASHES hashes, each pair of chunks a group of its own: block moves work, not results.
    """
    rooted = shared.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = rooted.filter("node = first").select("key", F.col("root").alias("main"))
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n")).filter("lo != hi and n > 2")
    # bands often bring the same nodes together: each such bucket once
    once = split.groupBy("x", "y", "n").agg(F.min("key").alias("key"))
    buckets = saved(once.join(main, "key").select("key", "n", "main"), "buckets")
    met = joined_by(rooted.select("key", "node", "k", "root"), buckets, "key")
    members = saved(met.select("key", "node", "k", "root", (F.col("root") != F.col("main")).alias("minor")), "members")

    def chunks(where: Column) -> Column:
        return F.greatest(F.ceil(F.sum(where.cast("long")) / block), F.ceil(F.sum(F.when(where, F.col("k")).otherwise(0)) / HASHES), F.lit(1)).cast("int")

    counts = members.groupBy("key").agg(chunks(F.col("minor")).alias("rows"), chunks(F.lit(True)).alias("columns"))
    counted = members.join(counts, "key")
    # the side that repeats draws its place from one hash, the other side from another
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    minors = counted.filter("minor").select("key", "node", "root", F.lit(True).alias("minor"), place(2, "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    others = counted.select("key", "node", "root", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), place(3, "columns").alias("j"))
    dealt = minors.unionByName(others).groupBy("key", "i", "j", "node", "root").agg(F.max("minor").alias("minor"))

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        found = joining(group.column("root").to_pylist(), group.column("minor").to_numpy(), sets, similarity)
        return pa.table({x: pa.array([nodes[p[i]] for p in found], pa.binary()) for i, x in enumerate("ab")})

    importable(shared.sparkSession)
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def print_pairs(nodes: DataFrame, distance: int, block: int) -> DataFrame:
    """nodes: node, print. Pairs a, b of nodes whose fingerprints are the same or within distance: they join all such nodes."""
    first = saved(nodes.groupBy("print").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    same = joined_by(nodes.select("node", "print"), first.filter("n > 1"), "print").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select(F.col("print").alias("node")), distance, block).distinct()
    ends = [first.select(F.col("print").alias(x), F.col("first").alias(f"n{x}")) for x in "ab"]
    return same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))


def band_keys(nodes: DataFrame) -> DataFrame:
    """node, k, key for every band of a node."""
    return nodes.select("node", "k", F.posexplode("bands").alias("band", "v")).select("node", "k", F.xxhash64("band", "v").alias("key"))


def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs a, b that the components of (node, root) haven't joined."""
    ends = [of.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter("ra is null or rb is null or ra != rb").select("a", "b")


def near_dedup(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the smallest doc_id.

    Fingerprints within NEAR bits meet first, bands bring together what lies farther apart; either way the sets decide.
    A text of fewer than five words is compared by its whole word sequence. Rows that repeat a doc_id are told apart by place.
    """
    rows = located(docs)
    place = [f"{OWN}file", f"{OWN}row"]
    prints = saved(with_bands(rows.select(*place, F.col(doc_id).alias(f"{OWN}id"), F.col(text).alias(f"{OWN}text")), f"{OWN}text"), "prints")
    rank = F.struct(F.col(f"{OWN}id").isNull(), F.col(f"{OWN}id"), *place)
    nodes = saved(prints.groupBy("node").agg(F.min(rank).alias("least"), F.first("k").alias("k"), F.first("print").alias("print"), F.first("bands").alias("bands")), "nodes")
    met = saved(print_pairs(nodes, NEAR, block), "met")
    keyed = band_keys(nodes).repartition("key")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    # as in links(): first, which is the least node, keeps counting and joining on one exchange
    shared = saved(keyed.join(sizes, "key").filter(F.col("node") >= F.col("first")), "shared")
    wanted = shared.select("node").unionByName(met.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    held = wanted.join(nodes, "node").select("node", *(F.col("least")[c].alias(c) for c in place))
    sets = saved(with_shingles(rows.select(*place, F.col(text).alias(f"{OWN}text")).join(held, place), f"{OWN}text"), "sets")
    near = saved(verified(met, sets, similarity), "near")
    stars = shared.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    far = saved(verified(apart(stars, connected_components(near)), sets, similarity), "far")
    joined = near.unionByName(far)
    more = other_links(shared, connected_components(joined), sets, similarity, block)
    of = connected_components(saved(joined.unionByName(more), "links"))
    root = nodes.join(of, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("best"))
    stays = root.select(*(F.col("best")[c].alias(c) for c in place))
    return rows.join(stays, place, "left_semi").select(*docs.columns)
