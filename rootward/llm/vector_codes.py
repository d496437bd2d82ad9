"""Compressed vectors: product codes of 16 parts with 64 integer entries each.

A component x becomes floor(256 * x). Every part of a vector is coded by the nearest entry
of its part's codebook, which two rounds of means fit to all vectors. The nearest entry is
found by equal-average search: entries are sorted by the sum of their components, and from
the place of a part's own sum the search goes outwards on both sides, the smaller gap first.
By Cauchy and Schwarz a squared distance is at least the squared gap of the sums over the
number of components, so the search ends when that strictly exceeds the best distance; a tie
is therefore always seen, and goes to the lower index.

A round is one pass over the vectors. Tasks add up what their own vectors give to each entry
before anything is shuffled, so a vector that is there a million times is no hot key, and what
reaches the driver is the codebook: 64 rows for each component of a vector at most.

Defined results: vectors that are null or hold a null, NaN or infinity are left out. The
dimension is that of the vector with the smallest vec_id among those whose length is a positive
multiple of 16; what is left has another length, empty ones included, gets a null code and a null
error. The first codebook has the 64 smallest vec_ids, nulls last, rows of one vec_id by their
components; fewer vectors make fewer entries. Repeated rows are each coded and count each. Integer
components are held to +-`limit(dimension)` (65,536 in terms of x for up to 1,024 dimensions), as
a long could not hold the error else. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import batches, small_or_shuffled, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Sums of errors of so many labels at most go to all tasks.
FEW_LABELS = 100_000


def limit(dimension: int) -> int:
    """The largest integer component for which squared gaps and errors of a vector fit a long."""
    part = max(dimension // PARTS, 1)
    return 1 << 30 - max((part - 1).bit_length(), (dimension.bit_length() + 1) // 2)


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position within part]."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the vectors that have finite components only."""
    return vectors.select("vec_id", "label", "embedding").where(_finite(F.col("embedding")))


def integers(rows: DataFrame, dimension: int) -> DataFrame:
    """vec_id, label, v: the integer components of the kept vectors of that dimension."""
    most = float(limit(dimension))
    held = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(most)), F.lit(-most))).cast("long"))
    return rows.where(F.size("embedding") == dimension).select("vec_id", "label", held.alias("v"))


def _components(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry that is nearest to each row of parts."""
    n, (k, width) = len(parts), entries.shape
    by_sum = np.argsort(entries.sum(axis=1), kind="stable")
    ordered, own = entries[by_sum], parts.sum(axis=1)
    far = np.iinfo(np.int64).max
    # Behind either end stands a sum that no row gets to.
    sums = np.concatenate(([0], ordered.sum(axis=1), [0]))
    up = np.searchsorted(sums[1:-1], own) + 1
    down = up - 1
    index, best = np.full(n, k), np.full(n, far)
    rows = np.arange(n)
    while len(rows):
        at_up, at_down, total = up[rows], down[rows], own[rows]
        gap_up = np.where(at_up <= k, sums[at_up] - total, far)
        gap_down = np.where(at_down > 0, total - sums[at_down], far)
        rises, gap = gap_up <= gap_down, np.minimum(gap_up, gap_down)
        going = (gap < far) & ((index[rows] == k) | (np.where(gap < far, gap, 0) ** 2 <= np.where(index[rows] == k, 0, best[rows]) * width))
        rows, rises = rows[going], rises[going]
        place = np.where(rises, at_up[going], at_down[going]) - 1
        away = ((parts[rows] - ordered[place]) ** 2).sum(axis=1)
        entry = by_sum[place]
        closer = (away < best[rows]) | (away == best[rows]) & (entry < index[rows])
        index[rows[closer]], best[rows[closer]] = entry[closer], away[closer]
        up[rows] += rises
        down[rows] -= ~rises
    return index, best


def assign(components: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances by (vector, part)."""
    n, (parts, _, width) = len(components), entries.shape
    cut = components.reshape(n, parts, width)
    found = [nearest(cut[:, p], entries[p]) for p in range(parts)]
    return np.stack([x for x, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _means(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The next codebooks: floors of the means of what is assigned to each entry; unused ones stay."""
    parts, k, width = entries.shape
    schema = pa.schema([("place", pa.int64()), ("total", pa.int64()), ("n", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for b in found:
            components = _components(b, parts * width)
            if len(components):
                slot = (assign(components, entries)[0] + np.arange(parts) * k).ravel()
                np.add.at(totals, slot, components.reshape(-1, width))
                counts += np.bincount(slot, minlength=parts * k)
        used = np.flatnonzero(counts)
        yield from batches(schema, [[(used[:, None] * width + np.arange(width)).ravel(), totals[used].ravel(), np.repeat(counts[used], width)]])

    sums = rows.select("v").mapInArrow(run, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    following = entries.copy()
    for r in sums.collect():
        following.reshape(-1)[r.place] = r.total // r.n
    return following


def train(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks fitted to all vectors; None where no vector can be coded."""
    rows = kept(vectors)
    whole = rows.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    first = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    found = whole.select("vec_id", "embedding").orderBy(*first).select(F.size("embedding").alias("n")).head(1)
    if not found:
        return None
    dimension = found[0].n
    coded = integers(rows, dimension)
    start = coded.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").head(ENTRIES)
    entries = np.array([r.v for r in start], np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        entries = _means(coded, entries)
    return Codebooks(entries)


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, code, error of every kept vector; code and error are null where it has another dimension."""
    rows = kept(vectors)
    nothing = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if books is None:
        return rows.select("vec_id", "label", *nothing)
    entries, dimension = books.entries, books.dimension
    digits = np.array([f"{i:02x}" for i in range(entries.shape[1])])
    slim = integers(rows, dimension)
    kinds = slim.schema

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            index, away = assign(_components(b, dimension), entries)
            code = ["".join(x) for x in digits[index].tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(away.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = slim.mapInArrow(run, f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long")
    return coded.unionByName(rows.where(F.size("embedding") != dimension).select("vec_id", "label", *nothing))


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with `decoded`, the vector that each code stands for (the middle of an integer's range)."""
    values = F.lit([[[(c + 0.5) / SCALE for c in entry] for entry in part] for part in books.entries.tolist()])
    place = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(values, F.lit(p)), place(p)) for p in range(PARTS)]
    return codes.withColumn("decoded", F.when(F.col("code").isNotNull(), F.concat(*parts)))


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    books = train(vectors)
    coded = written(encode(vectors, books), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    found = coded.join(small_or_shuffled(sums, FEW_LABELS), F.col("label").eqNullSafe(F.col("of_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
