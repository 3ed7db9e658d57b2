"""Line dedup: overlapping three-line windows, DataFrame operations only.

A line is what stands between line ends, exactly as written. Windows of three consecutive lines are hashed; where a
window occurs more than once anywhere, all its occurrences but the first by (doc_id, place of the row, position) go, and
the positions that such windows cover are merged.

Defined results: a null text counts as empty; a text of fewer than three lines has no window and stays; rows that repeat
a doc_id, or have none, are documents of their own, told apart by where they are stored, and a null doc_id comes first; a
window repeated inside one document stays once; an empty table gives an empty result; extra columns are carried along
untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import OWN, text_of


def covered_lines(rows: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rows: with spans.PLACE."""
    lines = spans.once(rows.select(*spans.PLACE, F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), lines=spans.lines_of(text_of("text")))
    return spans.repeated(lines.select(*spans.PLACE, "doc_id", F.inline(spans.runs("lines", width))))


def dedup(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with __llm_units (lines before), __llm_covered (removed positions or null), __llm_kept_in and __llm_clean (the text that is left)."""
    rows = spans.placed(docs)
    return spans.report(rows, covered_lines(rows, width, text, doc_id), spans.lines_of(F.col(f"{OWN}text")), text_of(text), "\n", OWN)
