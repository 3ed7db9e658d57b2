"""Language ID by compression: whole texts encoded with each language's zstandard raw-content dictionary.

A language's dictionary holds KILOBYTES of its text, from a bounded sample of its labelled documents: about SAMPLE of
them, drawn by a hash of their rows, of each up to PIECES pieces of PIECE characters spread over the whole text; first
every document's first piece, then every one's second, and so on. All languages that have labelled text are learned. A
text's letters are lowered, what isn't a letter separates words, and a word that is repeated at once counts once, since
repeats cost next to nothing in any language. The text is encoded in blocks with every language's dictionary, and the
language with the fewest bytes in all is chosen. Where the next language needs hardly more bytes (NARROW), the choice is
rejected: `accepted` is false and the score low.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text if no language was
learned; rows that repeat stay rows of their own; an empty table gives an empty result; other columns come back as they
were, but those named like a result give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.workers import mapped

from .common import OWN, others, text_of

SAMPLE, PIECES, PIECE, KILOBYTES = 600, 4, 256, 256
LEVEL, BLOCK = 9, 4096
#: Languages whose prepared dictionaries a worker holds at once; of more, it prepares them by turns for every batch.
HELD = 64
#: Share of the best size by which the next one must exceed it.
NARROW = 0.004
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def bare(text: str) -> bytes:
    """The words of a text, in lower case, with a space on either side."""
    words = [w for w, _ in groupby(_LETTERS.findall(text.lower()))]
    if not any(c.isalpha() for w in words for c in w):
        return b""
    return f" {' '.join(words)} ".encode("utf-8", "surrogatepass")


class Classifier:
    """dictionaries: by language, its dictionary's content."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)  # of equal sizes, the first one's is taken: the most frequent language's
        contents = list(dictionaries.values())
        self.turns = [contents[at : at + HELD] for at in range(0, len(contents), HELD)]
        self.kept = [coders(x) for x in self.turns] if len(self.turns) == 1 else None

    def sizes(self, plain: list[bytes]) -> np.ndarray:
        """Bytes that each language (column) needs for each text (row)."""
        columns = []
        for row in self.kept or map(coders, self.turns):
            part = [[sum(len(c.compress(x[at : at + BLOCK])) for at in range(0, len(x), BLOCK)) for c in row] for x in plain]
            columns.append(np.array(part, float).reshape(len(plain), len(row)))
        return np.hstack(columns)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        plain = [bare(t) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        out = []
        for x, sizes in zip(plain, self.sizes(plain), strict=True):
            if not x:
                out.append((UNKNOWN, 0.0, False))
                continue
            best = int(sizes.argmin())
            over = sizes - sizes[best]
            second = np.partition(over, 1)[1] if len(over) > 1 else np.inf
            out.append((self.languages[best], float(1 / np.exp(-over / 2).sum()), bool(second >= NARROW * sizes[best])))
        return out


def coders(contents: list[bytes]) -> list[zstandard.ZstdCompressor]:
    row = []
    for own in contents:
        content = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        row.append(zstandard.ZstdCompressor(dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
    return row


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def pieces(text: str) -> Column:
    """The whole of a text where it is short, else PIECES pieces spread evenly from its beginning to its end."""
    n = F.length(text)
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col(text), F.floor(i * (n - PIECE) / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)))
    return F.when(n <= PIECES * PIECE, F.array(F.col(text))).otherwise(spread)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language, from documents that aren't held out; the most frequent language first."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**63 - 1)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return {}
    # a share of the hash's range that about SAMPLE different rows fall into
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, (2**63 - 1) * min(SAMPLE, r.different) // r.different) for r in counts], "lang string, most long"))
    sample = rows.join(shares, "lang").filter("h <= most").select("lang", "h", pieces("text").alias("pieces")).dropDuplicates(["lang", "h"]).collect()
    parts: dict[str, list[list[str]]] = {}
    for r in sorted(sample, key=lambda r: (r.lang, r.h)):
        parts.setdefault(r.lang, []).append(r.pieces)
    out = {}
    for name in (r.lang for r in counts):
        held = bytearray()
        for k in range(PIECES):
            for own in parts.get(name, []):
                if k < len(own) and len(held) < KILOBYTES << 10:
                    held += bare(own[k])
        # the library takes no dictionary of under eight bytes
        out[name] = bytes(held[: KILOBYTES << 10]).ljust(8)
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with its text replaced by lang_pred, score and accepted."""
    results = ["lang_pred", "score", "accepted"]
    rest = others(docs, text, *results)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # KILOBYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value)
        for batch in batches:
            found = own.predict(batch.column(len(rest)).to_pylist())
            names, scores, sure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], [*rest, *results])

    rows = docs.select(*rest, text_of(text).alias(f"{OWN}text"))
    return mapped(rows, run, rows.drop(f"{OWN}text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean"))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs))
