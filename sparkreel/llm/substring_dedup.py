"""Substring dedup: sliding spans of consecutive sentences, joined globally.

From every sentence on, the shortest run of two sentences or more that holds LEAST bytes is a span, and so is the
shortest such run that ends with it: short sentences make long runs, so a repeated passage of LEAST bytes is found and
covered whole, from its first sentence to its last, however its sentences are cut. Less than that (two stock phrases of
a few words) isn't taken for a repeat. Spans are hashed over the trimmed sentences; every occurrence but the first by
(doc_id, place of the row, position) is removed, sentence by sentence.

Defined results: a null text counts as empty; a text of one sentence, or of fewer than LEAST bytes, stays; rows that
repeat a doc_id, or have none, are documents of their own, told apart by where they are stored, and a null doc_id comes
first; a span repeated inside one document stays once; an empty table gives an empty result; extra columns are carried
along untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.workers import mapped

from . import spans
from .common import OWN, text_of

#: UTF-8 bytes of a run, of its trimmed sentences with a line end between.
LEAST = 100
#: Runs handed on at once.
HELD = 1 << 16
#: spans.sentences_of() in Python: where runs are hashed, sentences are told apart, too.
SENTENCE = re.compile(rf"[^{spans.ENDS}\n]+[{spans.ENDS}\n]*|[{spans.ENDS}\n]+")


def sentence_runs(sentences: list[bytes], least: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs of two or more that hold least bytes, from every sentence on and up to every one."""
    n = len(sentences)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, sentences), np.int64, n) + 1)))
    place = np.arange(n)
    ends = np.maximum(np.searchsorted(at, at[:-1] + least + 1), place + 2)
    firsts = np.minimum(np.searchsorted(at, at[1:] - least - 1, "right") - 1, place - 1)
    forward, back = ends <= n, firsts >= 0
    return sorted({*zip(place[forward].tolist(), ends[forward].tolist(), strict=True), *zip(firsts[back].tolist(), (place[back] + 1).tolist(), strict=True)})


def windows(rows: DataFrame, least: int) -> DataFrame:
    """rows: spans.PLACE, doc_id, text. The same but for the text, and pos, size, key, of every span."""
    carried = [*spans.PLACE, "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pos, size, keys = [], [], [], []

            def out() -> pa.RecordBatch:
                made = [*(batch.column(c).take(pa.array(owner, pa.int32())) for c in carried), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(keys, pa.binary())]
                for x in (owner, pos, size, keys):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, [*carried, "pos", "size", "key"])

            for i, text in enumerate(batch.column("text")):
                sentences = [x.strip(" \n").encode("utf-8", "surrogatepass") for x in SENTENCE.findall(text.as_py() or "")]
                for a, b in sentence_runs(sentences, least):
                    owner.append(i)
                    pos.append(a)
                    size.append(b - a)
                    keys.append(xxhash.xxh3_128_digest(b"\n".join(sentences[a:b])))
                    if len(keys) == HELD:
                        yield out()
            yield out()

    return mapped(rows, run, rows.drop("text").schema.add("pos", "integer").add("size", "integer").add("key", "binary"))


def covered_sentences(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """rows: with spans.PLACE."""
    return spans.repeated(windows(rows.select(*spans.PLACE, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), least))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """docs with __llm_units (sentences before), __llm_covered (removed positions or null), __llm_kept_in and __llm_clean (the text that is left)."""
    rows = spans.placed(docs)
    return spans.report(rows, covered_sentences(rows, text, doc_id, least), spans.sentences_of(F.col(f"{OWN}text")), text_of(text), "", OWN)
