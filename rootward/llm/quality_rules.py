"""Quality rules by distribution divergence.

Every document gives two histograms: its characters by class and its words by common
word. Both are held against the reference of its language, which is the sum of the
histograms of all different documents of that language that pass the base rules (short and
repetitive documents are no yardstick), by the Jensen-Shannon distance (base 2, 0 to 1). A
distance counts only for documents long enough for it to mean something, and so does a
bound on the sum of both.

Words are runs of anything but the six ASCII white-space characters. Defined results: a
null or empty text has no words and fails; a null language is a language of its own;
repeated rows each give a row; a language without any word, or without a document that
passes the base rules, gives distance 0; a language without words in `COMMON` has all of
them in the last place of its reference, so that only character classes tell its documents
apart; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import batches, small_batches, small_or_shuffled, texts, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Below these lengths a distance is not looked at.
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_COMMON = 200, 80
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE, MAX_BOTH = 0.26, 0.42, 0.56
MAX_LANGUAGES_TO_ALL = 10_000
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "mark", "symbol", "accented", "other")
#: Frequent function words of English, German, French and Spanish.
COMMON = tuple(
    "the of and to in is that it was for on are with as be at by this from or "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "le la les et en un du une que est pour qui dans par plus pas sur au avec "
    "el los del las se por con no su para al lo como más pero sus ha me si sin".split()
)


def _class_of_byte() -> np.ndarray:
    """Character class by UTF-8 byte, a column per class; continuation bytes count for none."""
    table = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            name = "accented" if b in (0xC3, 0xC4, 0xC5) else "other"
        elif b >= 0x80:
            continue
        elif c.isalpha():
            name = "lower" if c.islower() else "upper"
        elif c.isdigit():
            name = "digit"
        elif c in " \t\n\v\f\r":
            name = "blank"
        elif b in SYMBOLS:
            name = "symbol"
        else:
            name = "mark" if c.isprintable() else "other"
        table[b, CLASSES.index(name)] = 1
    return table


CLASS_OF_BYTE = _class_of_byte()
_COMMON_AT = {w.encode(): i for i, w in enumerate(COMMON)}


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    often = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= often
    return int(covered.sum())


def measures(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = by_byte @ CLASS_OF_BYTE
    word_chars = len(text) - int(by_byte[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(by_byte[list(SYMBOLS)].sum())
    common = [0] * (len(COMMON) + 1)
    counts = Counter(data.lower().split())
    for w, i in _COMMON_AT.items():
        common[i] = counts.get(w, 0)
    common[-1] = len(words) - sum(common)
    return len(words), word_chars, symbols, duplicate_lines(text), repeated_words(words), classes.tolist(), common


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the measures of every document."""
    small_batches(docs.sparkSession)
    ints = pa.list_(pa.int64())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(n, pa.int64()) for n in names], ("classes", ints), ("common", ints)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(schema, ([b.column("doc_id"), b.column("lang"), *map(list, zip(*map(measures, texts(b)), strict=True))] for b in parts if b.num_rows))

    out = "doc_id long, lang string, " + ", ".join(f"{n} long" for n in names) + ", classes array<long>, common array<long>"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return slim.mapInArrow(run, out)


def references(rows: DataFrame) -> DataFrame:
    """Per language, the sums of both histograms over all its documents that pass the base
    rules; copies count once, so that a text that fills a third of the corpus is not what the
    others are held against."""
    def sums(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(f"all_{name}")

    different = rows.where(~base_failed()).select("lang", "n_words", "word_chars", "classes", "common").distinct()
    return different.groupBy("lang").agg(sums("classes", len(CLASSES)), sums("common", len(COMMON) + 1))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 where one of them is empty or null."""
    total = lambda x: f"aggregate({x}, 0L, (a, b) -> a + b)"
    part = lambda x: f"IF({x} > 0, {x} * log2(2 * {x} / (a / t.p + b / t.q)), 0D)"
    each = f"zip_with({p}, {q}, (a, b) -> 0.5D * ({part('a / t.p')} + {part('b / t.q')}))"
    # The array of one struct binds both totals, so that they are added up once and not for each place.
    bound = f"transform(array(struct({total(p)} AS p, {total(q)} AS q)), t -> IF(t.p > 0 AND t.q > 0, sqrt(greatest(aggregate({each}, 0D, (a, b) -> a + b), 0D)), 0D))"
    return F.expr(f"coalesce(({bound})[0], 0D)")


def judged(
    docs: DataFrame,
    min_chars: int = MIN_CHARS_FOR_CLASSES,
    min_words: int = MIN_WORDS_FOR_COMMON,
    max_class: float = MAX_CLASS_DISTANCE,
    max_common: float = MAX_COMMON_DISTANCE,
    max_both: float = MAX_BOTH,
) -> DataFrame:
    """A row per document: base measures, base_failed, kept, both distances."""
    rows = written(measured(docs), "measures")
    reference = references(rows).withColumn("_lang", F.coalesce("lang", F.lit(""))).withColumn("_none", F.col("lang").isNull()).drop("lang")
    rows = rows.withColumn("_lang", F.coalesce("lang", F.lit(""))).withColumn("_none", F.col("lang").isNull())
    # A row per language: few of them go to all tasks, so that a frequent language is no partition of its own.
    both = rows.join(small_or_shuffled(reference, MAX_LANGUAGES_TO_ALL), ["_lang", "_none"], "left")
    both = both.withColumn("class_distance", js_distance("classes", "all_classes")).withColumn("common_distance", js_distance("common", "all_common"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    failed = base_failed()
    worded = (chars >= min_chars) & (F.col("n_words") >= min_words)
    odd = ((chars >= min_chars) & (F.col("class_distance") > max_class)) | ((F.col("n_words") >= min_words) & (F.col("common_distance") > max_common))
    odd = odd | (worded & (F.col("class_distance") + F.col("common_distance") > max_both))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"),
    )
