"""Token counts by a compiled tokenizer: see `bpe` for the transducer, the chunk maps and their composition.

Counts are those of the SentencePiece library for whole texts, without begin or end tokens. The model's bytes travel
with the tasks; each Python worker compiles the machine once and keeps it, within fixed bounds.

Defined results: a null text counts as empty and has no tokens; rows that repeat stay rows of their own; an empty table
gives an empty result; other columns come back as they were, but one named like the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.workers import mapped

from . import bpe
from .common import OWN, others, text_of

MODEL = "piece_bpe_32k.model"
_compiled: dict[int, bpe.Counter] = {}


def model_bytes(path: str | None = None) -> bytes:
    """The tokenizer's file, read on the driver. path: a .model file of BPE kind; the public one by default."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def counter_of(model: bytes) -> bpe.Counter:
    """This worker's machine for the model."""
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = bpe.Counter(bpe.Model(model))
    return _compiled[key]


def count(docs: DataFrame, model: bytes | None = None, text: str = "text", to: str = "n_tokens", chunk: int = 1 << 16) -> DataFrame:
    """docs with its text replaced by the number of the text's tokens, in a column named to."""
    rest, file = others(docs, text, to), model or model_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter_of(file)
        for batch in batches:
            counts = [bpe.count_tokens(x.as_py(), machine, chunk) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(counts, pa.int64())], [*rest, to])

    rows = docs.select(*rest, text_of(text).alias(f"{OWN}text"))
    return mapped(rows, run, rows.drop(f"{OWN}text").schema.add(to, "long"))


def report(docs: DataFrame, limit: int = 4096, **options) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    sized = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")
    return count(sized, **options).withColumn("over_limit", F.col("n_tokens") > limit)
