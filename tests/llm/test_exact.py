import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sparkreel.llm import exact_dedup, line_dedup, substring_dedup

ROWS = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "ba"), (7, "ba"), (None, "x"), (9, "x"), (8, "é" * 5000), (10, "a\x0bb "), (None, None)]


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.lpad(F.length(c).cast("string"), 8, "0"))])
@pytest.mark.parametrize("files", [1, 1000])
def test_against_brute_force_also_where_digests_clash(spark, digest, files):
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, digest long").repartition(3)
    rows = exact_dedup.classify(frame.select("doc_id", "text"), digest=digest, files_per_trigger=files).collect()
    want = brute(ROWS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == sorted((w[:3] for w in want), key=str)
    assert sum(r.kept for r in rows) == len({w[3] for w in want})
    if digest is exact_dedup.sha256:
        assert sorted(bytes(r.digest).hex() for r in rows) == sorted(w[3] for w in want)


def test_dedup_keeps_columns_and_one_row_a_group(spark, tmp_path):
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, digest long")
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for docs in (frame, stored):
        out = exact_dedup.dedup(docs)
        assert out.columns == frame.columns
        assert out.count() == len({w[3] for w in brute(ROWS)})
    assert exact_dedup.dedup(stored.limit(0)).count() == 0


def brute_spans(docs, units, run_of, join):
    """docs: doc_id to text. The text that is left of each."""
    seen, out, where = {}, {}, {}
    for d in sorted(docs, key=lambda d: (d is not None, d)):
        u = units(docs[d] or "")
        for i in range(len(u)):
            r = run_of(u, i)
            if r:
                seen.setdefault(r[0], []).append((d, i, r[1]))
        where[d] = u
    gone = {d: set() for d in docs}
    for places in seen.values():
        for d, i, n in places[1:]:
            gone[d] |= set(range(i, i + n))
    for d, u in where.items():
        out[d] = join.join(x for i, x in enumerate(u) if i not in gone[d]) if gone[d] else docs[d] or ""
    return out


def test_line_dedup_against_brute_force(spark):
    lines = [f"line {i}" for i in range(12)]
    docs = {1: "\n".join(lines), 2: "\n".join(["x", *lines[2:7], "y"]), 3: "\n".join(lines[:2]), 4: None, 5: "", 6: "a\na\na\na\na", 7: "\n".join(["q", *lines[9:12]]), None: "\n".join(lines[4:9])}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("covered", F.lit("kept"))
    out = line_dedup.dedup(frame)
    got = {r.doc_id: r["__llm_clean"] for r in out.collect()}
    assert got == brute_spans(docs, lambda t: t.split("\n"), lambda u, i: (tuple(u[i : i + 3]), 3) if i + 3 <= len(u) else None, "\n")
    assert {r.covered for r in out.collect()} == {"kept"}
    assert line_dedup.dedup(frame.limit(0)).count() == 0


def sentence_units(t):
    return re.findall(r"[^.!?。！？…؟۔।\n]+[.!?。！？…؟۔।\n]*|[.!?。！？…؟۔।\n]+", t)


def brute_sentences(docs, least):
    """docs: doc_id to text. Sentences removed of each: shortest runs of two or more that hold least bytes, from each sentence on and up to each."""
    seen, gone = {}, {d: set() for d in docs}
    for d in sorted(docs, key=lambda d: (d is not None, d)):
        bare = [x.strip(" \n") for x in sentence_units(docs[d] or "")]
        n, runs = len(bare), set()
        holds = lambda a, b: len("\n".join(bare[a:b]).encode()) >= least
        for i in range(n):
            runs |= set([(i, z) for z in range(i + 2, n + 1) if holds(i, z)][:1])
            runs |= set([(a, i + 1) for a in range(i) if holds(a, i + 1)][-1:])
        for a, b in sorted(runs):
            key = "\n".join(bare[a:b])
            first = seen.setdefault(key, (d, a))
            if first != (d, a):
                gone[d] |= set(range(a, b))
    return {d: "".join(x for i, x in enumerate(sentence_units(t or "")) if i not in gone[d]) for d, t in docs.items()}


@pytest.mark.parametrize("least", [0, 30, substring_dedup.LEAST])
def test_substring_dedup_against_brute_force(spark, least):
    s = [f"This is sentence number {i} of the passage that goes round and round." for i in range(9)]
    short = ["He said no.", "She left him.", "They were sad.", "It rained.", "So what?", "Nobody knew.", "Then it was over.", "All went home.", "The end came.", "Yes."]
    chinese = "他说不行。她离开了他。大家都很难过。天下着雨。那又怎样？没有人知道。后来一切都结束了。大家都回家了！"
    docs = {
        1: " ".join(s), 2: "Own start here. " + " ".join(s[2:6]) + " Own end.", 3: "A. B. C. D.", 4: "A. B. C. D.", 5: None, 6: "", 7: s[0] + "\n" + s[1], 8: " ".join([s[0]] * 5),
        9: "Before it. " + " ".join(short), 10: "Something else stood here. " + " ".join(short) + " And after it.", 11: "前面的话。" + chinese, 12: "别的。" + chinese + "完。",
        13: "\n\n..." + " ".join(short[2:5]), 14: "x " * 100_000 + ". " + "Word. " * 150 + s[3] + " " + s[4], None: "Else. " + s[7] + " " + s[8],
    }
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"once": F.lit(1), "key": F.lit("k"), "__llm_x": F.lit(2)})
    out = substring_dedup.dedup(frame, least=least)
    got = {r.doc_id: r["__llm_clean"] for r in out.collect()}
    assert got == brute_sentences(docs, least)
    assert {(r.once, r.key) for r in out.collect()} == {(1, "k")}
    if least == substring_dedup.LEAST:  # a passage goes whole, and nothing else
        assert got[3] == got[4] == docs[3] and got[2] == "Own start here. Own end."
        assert got[10] == "Something else stood here. And after it." and got[12] == "别的。完。"
        assert substring_dedup.dedup(frame.limit(0)).count() == 0


def test_runs_of_very_frequent_keys_are_split(spark, monkeypatch):
    """A line triple in most documents: its rows are dealt out, the result is the same."""
    stock = ["license", "of the", "stock kind"]
    docs = {i: "\n".join([f"own {i}", *stock, f"end {i}"]) for i in range(700)} | {1000 + i: "\n".join([f"pair {i // 2}", "x", "y"]) for i in range(40)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id string, text string").withColumn("once", F.lit("mine"))
    out = line_dedup.dedup(frame).collect()
    got = {r.doc_id: r["__llm_clean"] for r in out}
    assert got == brute_spans({str(k): v for k, v in docs.items()}, lambda t: t.split("\n"), lambda u, i: (tuple(u[i : i + 3]), 3) if i + 3 <= len(u) else None, "\n")
    assert {r.once for r in out} == {"mine"}


@pytest.mark.parametrize("most", [0, 10**6])
def test_exact_dedup_of_a_hot_text(spark, most):
    rows = [(i, "the same  text" if i % 3 else f"text {i // 6}") for i in range(1500)]
    frame = spark.createDataFrame([(str(d), t, 1) for d, t in rows], "doc_id string, text string, best int")
    got = exact_dedup.classify(frame, most=most).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.group_size, []).append(r)
    assert len(sizes[1000]) == 1000 and {r.keep_id for r in sizes[1000]} == {"1"} and sum(r.kept for r in sizes[1000]) == 1
    assert len(sizes[2]) == 500 and sum(r.kept for r in got) == 251


def brute_rows(rows, units, size, join):
    """rows: (doc_id, text), stored in this order. Sorted (doc_id, text that is left), with runs of size units."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    gone = {}
    for i in order:
        u = units(rows[i][1] or "")
        gone[i] = set()
        for p in range(len(u) - size + 1):
            key = tuple(x.strip(" \n") if size == 2 else x for x in u[p : p + size])
            if seen.setdefault(key, (i, p)) != (i, p):
                gone[i] |= set(range(p, p + size))
    for i, (doc, text) in enumerate(rows):
        u = units(text or "")
        out.append((doc, join.join(x for k, x in enumerate(u) if k not in gone[i]) if gone[i] else text or ""))
    return sorted(out, key=str)


SHARED = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\ny\nz\nw"), (5, "k\nl\nm\nn"), (5, "k\nl\nm\nn"), (None, "p\nq\nr"), (None, "s\nt\nu\nv"), (None, "p\nq\nr"), (7, "s\nt\nu"), (7, None), (7, "")]


def test_rows_of_one_doc_id_or_none_are_told_apart(spark):
    lines = [(r.doc_id, r["__llm_clean"]) for r in line_dedup.dedup(spark.createDataFrame(SHARED, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(lines, key=str) == brute_rows(SHARED, lambda t: t.split("\n"), 3, "\n")
    assert (2, "x\ny\nz\nw") in lines and (2, "") in lines
    rows = [(d, t and t.replace("\n", ". ") + ".") for d, t in SHARED]
    left = [(r.doc_id, r["__llm_clean"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), least=0).collect()]
    assert sorted(left, key=str) == brute_rows(rows, sentence_units, 2, "")


NAMED = [(i, t, "m") for i, t in enumerate(["a b c d e f g h. " * 8, "a b c d e f g h. " * 8, "i j k l m n o p q. " * 8])]


@pytest.mark.parametrize("name", ["_metadata", "_Metadata", "file"])
def test_a_column_named_like_the_place_of_a_row(spark, name, tmp_path):
    from sparkreel.llm import minhash, simhash

    made = spark.createDataFrame(NAMED, f"doc_id long, text string, `{name}` string").coalesce(1)
    made.write.parquet(str(tmp_path / "t"))
    for docs in (made, spark.read.parquet(str(tmp_path / "t"))):
        assert sorted(r.kept for r in exact_dedup.classify(docs).collect()) == [False, True, True]
        for dedup in (exact_dedup.dedup, simhash.near_dedup):
            out = dedup(docs)
            assert out.columns == docs.columns
            assert sorted((r.doc_id, r[name]) for r in out.collect()) == [(0, "m"), (2, "m")]
        assert sorted((r.doc_id, r.kept) for r in minhash.classify(docs).collect()) == [(0, True), (1, False), (2, True)]
        assert {r[name] for r in line_dedup.dedup(docs).collect()} == {"m"}
