"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + pairs), where all pairwise interactions
sum_{i<j} <v_i, v_j> x_i x_j are had in linear time as
half of (sum v_if x_i)^2 - sum v_if^2 x_i^2, summed over the factors f.

x holds the words of a text, lower-cased (A-Z) and hashed by CRC-32 into `BUCKETS`
places, weighted by 1 + log(count) and scaled to length 1; shares that describe its
structure; and the stated length in characters with a flag for a missing one.
Labels, language, source and doc_id are never inputs.

It is fitted on at most `MAX_ROWS` labelled documents, the first in the order of a hash of
doc_id (a documented bound: features of so many rows fit the driver), by mini-batch
AdaGrad with a fixed seed. Every document is scored.

Defined results: a null or empty text is scored from the constants alone; documents with
contradicting labels take the mean label, 0.5 counting as 1; labels of one kind give a
constant score on their side, and so does a table without labels, which is taken as all of
label 1 (nothing is rejected); repeated rows each give a row; other columns are kept as they
are, `score` and `predicted` included where `accepted` is asked.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rootward.llm.common import batches, named, small_batches, texts, unused

BUCKETS, FACTORS, MAX_ROWS, EPOCHS, BATCH, SEED = 1 << 15, 8, 8000, 8, 64, 7
RATE, DECAY = 0.05, 1e-5
STRUCTURE = (
    "constant", "length", "word_length", "upper", "digit", "symbol", "mark", "bar", "shout", "line",
    "repeated_line", "distinct", "accented", "stated_length", "no_stated_length",
)
SIZE = BUCKETS + len(STRUCTURE)
_UPPER, _DIGIT = list(range(65, 91)), list(range(48, 58))
_SYMBOL, _MARK = list(b"#*$%&<>@^~_=+\\{}[]"), list(b".,;:'\"()-?")


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    counts = Counter(words)
    m = len(counts)
    places = np.empty(m + len(STRUCTURE), np.int64)
    values = np.empty(m + len(STRUCTURE), np.float32)
    if m:
        places[:m] = np.fromiter(map(zlib.crc32, counts), np.int64, m) & (BUCKETS - 1)
        values[:m] = 1 + np.log(np.fromiter(counts.values(), np.float32, m))
        values[:m] /= math.sqrt(float(values[:m] @ values[:m]))
    size = max(1, len(data))
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    places[m:] = np.arange(BUCKETS, SIZE)
    values[m:] = (
        1, math.log1p(len(data)) / 12, min(3.0, len(data) / max(1, len(words)) / 8), 4 * by_byte[_UPPER].sum(), 4 * by_byte[_DIGIT].sum(),
        4 * by_byte[_SYMBOL].sum(), 4 * by_byte[_MARK].sum(), 8 * by_byte[124], 8 * by_byte[33], 8 * by_byte[10],
        1 - len(set(lines)) / max(1, len(lines)), m / max(1, len(words)), by_byte[128:].sum(),
        math.log1p(max(0, n_chars or 0)) / 12, n_chars is None,
    )
    return places, values


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        rows = self.factors[places] * values[:, None]
        s = rows.sum(axis=0)
        z = self.bias + float(self.linear[places] @ values) + 0.5 * float(s @ s - (rows * rows).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """AdaGrad on the log loss, both labels weighted alike up to a power of one half."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 1.0
    start = math.log((share + 1e-3) / (1 - share + 1e-3))
    model = Model(start, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    if share in (0.0, 1.0):
        model.factors[:] = 0
        return model
    weight = np.where(labels == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            own = order[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in own])
            cut = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            p, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            v = model.factors[p] * x[:, None]
            s = np.add.reduceat(v, cut, axis=0)
            z = model.bias + np.add.reduceat(model.linear[p] * x, cut) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), cut))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) * weight[own] / len(own)
            each = np.repeat(error, sizes).astype(np.float32)
            places, back = np.unique(p, return_inverse=True)
            g_w = np.bincount(back, each * x, len(places)) + DECAY * model.linear[places]
            slope = (each * x)[:, None] * (np.repeat(s, sizes, axis=0) - v)
            g_v = np.stack([np.bincount(back, slope[:, f], len(places)) for f in range(FACTORS)], 1) + DECAY * model.factors[places]
            seen_w[places] += g_w**2
            seen_v[places] += g_v**2
            seen_b += float(error.sum()) ** 2
            model.linear[places] -= RATE * g_w / np.sqrt(seen_w[places])
            model.factors[places] -= RATE * g_v / np.sqrt(seen_v[places])
            model.bias -= RATE * float(error.sum()) / math.sqrt(seen_b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _stated(docs: DataFrame) -> Column:
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def _views(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its own memory, so that the driver holds them once."""
    found = []
    for c in lists.chunks:
        flat, at = c.values.to_numpy(), c.offsets.to_numpy()
        found += [flat[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return found


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows documents with a label that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _stated(docs)).join(F.broadcast(sample), "doc_id")  # max_rows rows
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("places", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [features(x, n) for x, n in zip(texts(b), b.column("n_chars").to_pylist(), strict=True)]
            yield from batches(schema, [[b.column("doc_id"), b.column("label"), [p for p, _ in found], [v for _, v in found]]])

    got = rows.select("doc_id", "text", "n_chars", "label").mapInArrow(run, "doc_id long, label int, places array<int>, weights array<float>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    marks = got.column("label").to_numpy()[order].astype(np.float64)
    places, weights = _views(got.column("places")), _views(got.column("weights"))
    return fit([(places[i], weights[i]) for i in order.tolist()], marks)


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with the columns score (double) and predicted (int); docs must have none of these names."""
    if {score.lower(), predicted.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {score} or {predicted} already")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, stated = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in parts:
            counts = b.column(stated).to_pylist() if stated is not None else [None] * b.num_rows
            found = [own.score(*features(x, n)) for x, n in zip(texts(b, text), counts, strict=True)]
            yield b.append_column("s", pa.array(found, pa.float64())).append_column("p", pa.array([int(x >= 0.5) for x in found], pa.int32()))

    # By place: names may hold dots, which the Python call cannot take.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = StructType(plain.schema.fields + [StructField("s", DoubleType()), StructField("p", IntegerType())])
    return plain.mapInArrow(run, out).toDF(*docs.columns, score, predicted)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _stated(docs)), train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the classifier rejects; columns stay."""
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    return scored(docs, model, score, predicted).where(F.col(predicted) == 1).select(*named(docs))
