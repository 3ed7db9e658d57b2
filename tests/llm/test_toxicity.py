import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkreel.llm import toxicity

BAD = ["blorgut", "skrimzat", "quimbex"]


def corpus(n=400):
    rnd, docs, labels = random.Random(11), [], []
    word = lambda: "".join(rnd.choice(["ta", "no", "ri", "el", "su", "am", "ke"]) for _ in range(rnd.randrange(1, 4)))
    for i in range(n):
        w, toxic = [word() for _ in range(rnd.randrange(5, 80))], int(rnd.random() < 0.3)
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(BAD)
        docs.append((i, " ".join(w).capitalize() + ".", "xx"))
        labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_quality(spark):
    docs, labels = corpus()
    extra = [(9000, None, ""), (9001, "", ""), (9002, "123 ...", ""), (None, "tano", ""), (3, docs[3][1], "")]
    got = toxicity.classify(*frames(spark, [*docs, *extra], labels)).collect()
    assert len(got) == len(docs) + len(extra)
    of = {r.doc_id: r for r in got}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(of[i].held_out for i, _ in held)
    right = [of[i].predicted == t for i, t in held]
    assert np.mean(right) >= 0.95
    assert all(of[i].predicted == 0 and 0 <= of[i].score <= 1 for i in (9000, 9001, 9002))
    assert of[9000].score == of[9001].score == of[9002].score


def test_inserted_and_spelled_out_words_score_above_clean_ones():
    docs, labels = corpus()
    machine = toxicity.train([(t, y) for (_, t, _), (_, _, y) in zip(docs, labels, strict=True)])
    value = lambda x: machine.words([x])[0].max()
    clean = value("tano rielsu amke norita")
    for x in ("blorgut", "BLOR-GUT", "b l o r g u t", "blorxgut", "s.k.r.i.m.z.a.t", "blor3gut"):
        assert value(x) > clean, x


def test_kernel_equals_brute_force():
    words = ["abab", "abcd", "axbcd", "q", "zabcdz"]

    def phi(w):
        s, out = [0, *(ord(c) - 96 for c in w), 0], {}
        for i in range(len(s)):
            for a, b, c in toxicity.STEPS:
                at = (i, i + a, i + a + b, i + a + b + c)
                if at[3] < len(s) and 0 not in s[i + 1 : at[3]]:
                    key = tuple(s[k] for k in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (a + b + c - 3)
        return {k: v / float(toxicity.most(np.array([len(w)]))[0]) for k, v in out.items()}

    row, sub, weight = toxicity.features(words)
    for i, w in enumerate(words):
        want = phi(w)
        got = {}
        for r, n, v in zip(row, sub, weight, strict=True):
            if r == i:
                key = tuple(int(n) // toxicity.SYMBOLS**k % toxicity.SYMBOLS for k in (3, 2, 1, 0))
                got[key] = got.get(key, 0) + v
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want), w


def test_batches_do_not_change_scores():
    docs, labels = corpus(120)
    machine = toxicity.train([(t, y) for (_, t, _), (_, _, y) in zip(docs, labels, strict=True)])
    texts = [t for _, t, _ in docs] + ["", "a", " \n ", "x" * 3000, "i d", "Ω ß ÿ"]
    assert np.allclose(machine.score(texts), np.concatenate([machine.score([t]) for t in texts]), atol=1e-6)


def test_one_class_and_empty_table(spark):
    docs, labels = corpus(30)
    frame, some = frames(spark, docs, [(i, q, 0) for i, q, _ in labels])
    assert {r.score for r in toxicity.classify(frame, some).collect()} == {0.0}
    assert toxicity.classify(frame.limit(0), some.limit(0)).collect() == []


def test_string_ids_and_a_column_named_score(spark):
    docs, labels = corpus(120)
    frame = spark.createDataFrame([(f"d{i}", t) for i, t, *_ in docs], "doc_id string, text string").withColumn("Score", F.lit("mine"))
    some = spark.createDataFrame([(f"d{i}", q, y) for i, q, y in labels], "doc_id string, quality int, toxic int")
    got = toxicity.classify(frame, some)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and got.count() == len(docs)
    machine = toxicity.train(*toxicity.training_rows(frame, some))
    assert toxicity.score(frame, machine).columns == ["doc_id", "score"]
    # the query against the machine by hand, text by text
    by_hand = {f"d{i}": machine.score([t or ""])[0] for i, t, *_ in docs}
    assert all(abs(r.score - by_hand[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.5) for r in got.collect())


def score_by_hand(machine, text):
    """A text's score from the machine's numbers, letter by letter and word by word."""
    letters = lambda part: [ord(c) - 96 for c in part.lower() if "a" <= c <= "z"]
    words = [w for w in map(letters, text.split()) if w]
    joined = []
    for i, w in enumerate(words):
        if i and len(w) == 1 and len(words[i - 1]) == 1:
            joined[-1] = joined[-1] + w
        else:
            joined.append(w)
    values = []
    for w in joined:
        s, total = [0, *w, 0], 0.0
        for i in range(len(s)):
            for a, b, c in toxicity.STEPS:
                if i + a + b + c < len(s):
                    number = 0
                    for k in (i, i + a, i + a + b, i + a + b + c):
                        number = number * toxicity.SYMBOLS + s[k]
                    total += toxicity.DECAY ** (a + b + c - 3) * float(machine.table[number])
        values.append(total / float(toxicity.most(np.array([len(w)]))[0]) + machine.bias)
    top = sorted(values, reverse=True)
    first, third = (top[0] if top else toxicity.NOTHING), (top[2] if len(top) > 2 else toxicity.NOTHING)
    a, b, c = machine.logistic
    return 1 / (1 + np.exp(-min(30, max(-30, a * max(first, -3) + b * max(third, -3) + c))))


def test_query_equals_scores_by_hand(spark):
    docs, labels = corpus(160)
    odd = ["", "x", "b l o r g u t now", "Blor-gut! skrim.zat 12 q q", "a b", "one two three", "i i i and i"]
    frame, some = frames(spark, docs + [(1000 + i, t, "") for i, t in enumerate(odd)], labels)
    machine = toxicity.train(*toxicity.training_rows(frame, some))
    want = {i: score_by_hand(machine, t) for i, t, *_ in docs} | {1000 + i: score_by_hand(machine, t) for i, t in enumerate(odd)}
    got = toxicity.classify(frame, some).collect()
    assert len(got) == len(want) and len({round(r.score, 6) for r in got}) > 30
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-5 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
