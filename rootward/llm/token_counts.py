"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, by the streaming encoder. Its tokens are intervals of bytes, its sections
(lines, each with the line feed that ends it) are intervals too; an interval join brings
them together. A token that crosses a boundary goes by an explicit rule: `start` gives it
to the section that holds its first byte, `most` to the section that holds most of its
bytes (the earlier among equals). So every token counts exactly once and the counts of a
document add up to its number of tokens.

Defined results: a null or empty text is one empty section without tokens; a text that
ends in a line feed has no further section behind it; of a very long text the tokens are
held a piece at a time and the counts of its sections whole; repeated rows each give rows;
a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.llm.bpe import PIECE, Vocabulary, encoded, vocabulary
from rootward.llm.common import batches, small_batches, texts

RULES = ("start", "most")


def section_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of the lines of a text."""
    after = np.flatnonzero(data == 10) + 1
    return np.concatenate(([0], after[after < len(data)]))


def attributed(text: str, v: Vocabulary, size_of: np.ndarray, rule: str = "start", piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """By section: start and end in code points, tokens, and tokens that cross one of its bounds.

    Tokens are taken as the encoder emits them, a piece of the text at a time."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = section_starts(data)
    bounds = np.append(starts, len(data))
    counts, touched, at = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
    for ids in encoded(text, v, piece):
        if not ids:
            continue
        sizes = size_of[ids]
        ends = at + np.cumsum(sizes)
        begins, at = ends - sizes, int(ends[-1])
        # The interval join: the sections of each token's first and last byte.
        first, last = np.searchsorted(starts, begins, "right") - 1, np.searchsorted(starts, ends - 1, "right") - 1
        home, crossing = first.copy(), np.flatnonzero(first != last)
        for t in crossing:
            touched[first[t] : last[t] + 1] += 1
            if rule == "most":
                own = np.arange(first[t], last[t] + 1)
                home[t] = own[np.argmax(np.minimum(bounds[own + 1], ends[t]) - np.maximum(bounds[own], begins[t]))]
        low, high = int(home.min()), int(home.max()) + 1
        counts[low:high] += np.bincount(home - low, minlength=high - low)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points[starts], points[bounds[1:]], counts, touched


def sections(docs: DataFrame, rule: str = "start") -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: a row per section, code points, end exclusive."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    small_batches(docs.sparkSession)
    names = ("section", "start", "end", "n_tokens", "n_crossing")
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        size_of = np.zeros(max(v.bytes_of) + 1, np.int64)
        for i, n in v.size_of.items():
            size_of[i] = n
        for batch in parts:
            found = [attributed(x, v, size_of, rule) for x in texts(batch)]
            sizes = [len(f[0]) for f in found]
            at = np.repeat(np.arange(len(sizes)), sizes)
            number = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
            columns = [np.concatenate([f[k] for f in found]) if sizes else number for k in range(4)]
            yield from batches(schema, [[batch.column("doc_id").take(pa.array(at)), number, *columns]])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
