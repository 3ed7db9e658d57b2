"""The pipeline's stages against brute-force versions on a small corpus."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkreel.llm import sp_codec, token_counts


def word(rnd):
    return "".join(rnd.choice(["ta", "no", "ri", "el", "su", "am"]) for _ in range(rnd.randrange(1, 4)))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rnd, root = random.Random(8), tmp_path_factory.mktemp("sf")
    base = [[word(rnd) for _ in range(120)] for _ in range(60)]
    docs = [(i, " ".join(w) + ".", "aa", f"s{i % 3}") for i, w in enumerate(base)]
    item = " ".join(word(rnd) for _ in range(20))
    docs += [(100 + i, "  " + " ".join(base[i]) + ".\n", "aa", "s0") for i in range(10)]  # equal but for blanks, and longer
    for i in range(10, 20):
        w = list(base[i])
        w[50] = "changed"
        docs.append((100 + i, " ".join(w) + ".", "aa", "s1"))
    docs += [(200 + i, "#$% " * 50 + "@" * i, "aa", "s2") for i in range(5)]
    docs += [(300, f"{' '.join(base[59][:40])} {item} {' '.join(word(rnd) for _ in range(50))}", "aa", "s2"), (301, None, "aa", "s2")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), docs


def test_run_against_brute_force(spark, sf):
    root, docs = sf
    text = {i: t for i, t, *_ in docs}
    want = {i for i in text if i < 60} | set(range(100, 110))
    want -= set(range(10))  # their copies have more characters
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(got) == want
    encoder = sp_codec.encoder_of(token_counts.model_bytes())
    for i, r in got.items():
        assert r.round_trip and list(r.token_ids) == encoder.model.sp.encode(text[i])


def test_stages_keep_the_columns_of_documents(spark, sf):
    root, _ = sf
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).columns == docs.columns
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0]) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_nothing_is_left_but_the_result(spark, sf):
    root, _ = sf
    before = set(os.listdir(shared(spark)))
    out = corpus_pipeline.run(spark, root)
    left = set(os.listdir(shared(spark))) - before
    assert len(left) == 1 and next(iter(left)).startswith(corpus_pipeline.STAGES[-1][0]) and out.count() > 0


def shared(spark):
    return spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")


def test_empty_documents_and_columns_that_clash(spark, tmp_path, sf):
    root, _ = sf
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{root}/documents.parquet").withColumns({"n": F.lit(1), "node": F.lit("x"), "kept": F.lit(2), "h": F.lit(3), "once": F.lit(4), "bands": F.lit(5)}).limit(0)
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == ["doc_id", "lang", "source", "token_ids", "round_trip"]
    full = spark.read.parquet(f"{root}/documents.parquet").withColumns({"n": F.lit(1), "node": F.lit("x"), "kept": F.lit(2), "h": F.lit(3), "once": F.lit(4), "bands": F.lit(5)})
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        assert {(r.n, r.node, r.kept, r.h, r.once, r.bands) for r in stage(spark, full, root).select("n", "node", "kept", "h", "once", "bands").collect()} == {(1, "x", 2, 3, 4, 5)}
