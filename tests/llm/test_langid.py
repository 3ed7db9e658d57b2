import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from sparkreel.llm import langid

SYLLABLES = {"aa": ["tion", "the", "er", "ing", "and"], "bb": ["keit", "sch", "und", "ei", "ver"], "cc": ["ción", "que", "los", "ado", "ez"]}


def corpus(n=240):
    rnd, rows = random.Random(3), []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        text = " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(4, 60)))
        rows.append((i, text, lang, f"s{i % 3}"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    extra = [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "123 !!", None, "x"), (None, "tion the", None, None), (5, "keit schund", None, "x")]
    frame = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, score string")
    got = langid.classify(frame).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got if r.doc_id not in (5, None)}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False)
    held = [(i, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i != 5]
    assert all(by[i].held_out for i, _ in held) and len(held) > 20
    assert sum(by[i].lang_pred == lang for i, lang in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_lang_of_held_out_rows_is_not_read(spark):
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in corpus(80)]
    got = langid.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert "zz" not in {r.lang_pred for r in got}


def test_nothing_to_learn_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.classify(rows).collect()] == ["und"]
    assert langid.classify(rows.limit(0)).collect() == []


def test_narrow_margins_are_rejected():
    same = b" the same words in both of them again and again "
    ((name, score, sure),) = langid.Classifier({"a": same, "b": same}).predict(["the same words"])
    assert name == "a" and score == 0.5 and not sure
    assert langid.bare("A  a, B!") == b" a b " and langid.bare("12² _ ½") == b""


def test_query_against_brute_force(spark):
    """Every text with every dictionary, block by block."""
    rows = [*corpus(150), (900, "tion the er " * 4000, "aa", "x"), (901, "ción! " * 9, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    dictionaries = langid.learn(frame)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.classify(frame).collect()}
    for i, text, _, _ in rows:
        plain, sizes = langid.bare(text), {}
        for lang, content in dictionaries.items():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=langid.LEVEL)
            c = zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(plain[a : a + langid.BLOCK])) for a in range(0, len(plain), langid.BLOCK))
        best = min(sizes, key=sizes.get)
        assert got[i] == (best, pytest.approx(1 / sum(math.exp((sizes[best] - n) / 2) for n in sizes.values()))), i


def test_hundreds_of_languages_are_learned_and_prepared_by_turns(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    vocabulary = {f"l{k:03}": [word() for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join(rnd.choice(own) for _ in range(30)), lang) for lang, own in vocabulary.items() for i in rnd.sample(range(10**6), 4)]
    got = langid.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)).collect()
    want = {i: lang for i, _, lang in rows}
    assert len({r.lang_pred for r in got}) > 280
    assert sum(r.lang_pred == want[r.doc_id] for r in got if not r.held_out) == sum(not r.held_out for r in got)


def test_the_whole_of_a_long_text_is_learned_from(spark):
    long = "aber " * 3000 + "zwischenzeitlich unterdessen " * 300
    rows = [(i, x, lang) for i, (x, lang) in enumerate([(long, "de"), ("the one and only " * 20, "en"), ("the other one " * 20, "en")]) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert b"zwischenzeitlich" in langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["de"]


def test_copies_of_one_row_count_once_and_names_that_clash(spark):
    rows = [(1, "immer dasselbe", "de")] * 3000 + corpus_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Score", F.lit("mine")).withColumn("accepted", F.lit(1))
    assert langid.learn(frame)["de"].count(b"dasselbe") == 1
    out = langid.predict(frame, langid.learn(frame))
    assert out.columns == ["doc_id", "lang", "lang_pred", "score", "accepted"] and out.count() == len(rows)
    texts = frame.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert langid.classify(texts).schema["doc_id"].dataType.simpleString() == "string"


def corpus_rows():
    return [(100 + i, t, lang) for i, (_, t, lang, _) in enumerate(corpus(20))]


def test_a_language_of_a_few_letters_is_learned_too(spark):
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(kept[0], "ab", "xx"), (kept[1], "?", "yy")] + [(i, "the quick brown fox jumps over the lazy dog and runs " * 3, "en") for i in kept[2:60]]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"en", "xx", "yy"} and all(len(x) >= 8 for x in learned.values())
    got = langid.predict(spark.createDataFrame([("the quick brown fox runs over the dog",), (None,)], "text string"), learned).collect()
    assert [r.lang_pred for r in got] == ["en", "und"]
