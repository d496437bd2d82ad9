"""Benchmark decontamination, by built-in SQL functions only.

Words are runs of letters, digits and combining marks, lower-cased; shingles are five words.
For each benchmark item, windows of documents with as many shingles as the item are compared
with it:

1. Windows. A window with similarity s or more to an item of m shingles shares at least s m
   of them with it (for windows that the end of the text cuts short, too), and sliding it on
   to its first shared shingle lowers neither the shared count nor the similarity. So only
   windows count that begin at a shingle of the benchmark and hold s m that items of this
   size have. A bitmap of the benchmark's shingles, of bounded size, drops most documents
   before; it only ever lets too many pass. Nothing that could match is lost.
2. SimHash. Each such window gets a 64-bit fingerprint of its shingles, repeats counted.
3. Multi-index Hamming blocks. Fingerprints are cut into 4 blocks of 16 bits; two within the
   radius have a block within radius div 4 bits of each other, so items are indexed under
   all values within that distance of each of their blocks, and a window looks its own blocks
   up. That finds all fingerprints within the radius, and is how a window meets items at all;
   of unrelated fingerprints of one size, one pair in 23 shares a block.
4. Weighted similarity. Of each candidate, the sum of the smaller counts over the sum of
   the larger counts of each shingle; 0.8 or more is contamination.

Between fingerprints of two sets of similarity 0.8 about ten bits are expected to differ, with
a deviation of three; the radius is 15. The share of brute-force matches that is found is
measured in the tests (0.9 or more at a similarity of just 0.8, all of those above 0.9).

Items of fewer than five words are one shingle of that many words. Their windows are single
shingles too, whose fingerprint is their hash, and whose similarity is 1 or 0: equal hashes are
looked up, in texts of any length.

Defined results: null texts have no words and match nothing, nor do items without words;
repeated rows count as one document, with its best window, the first among equals; a null
doc_id is kept as such; items with one item_id and different texts are compared each by
itself, the best counts; empty tables match nothing; other columns are ignored by `report` and
kept by `clean`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import named, unused, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS, BITS = 5, 0.8, 15, 4, 16
#: Tables of up to so many counted rows are sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Longs of 64 bits in the bitmap: 32 KB, whatever the size of the benchmark.
BITMAP = 1 << 12


def words(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def once(value: Column) -> Column:
    """value by a generator of one row: filters on it are not pushed below, which would
    repeat costly expressions for each mention, even for each element of an array."""
    return F.explode(F.array(value))


def shingle_hashes(of: str, size: int = SHINGLE) -> Column:
    """Hash of each run of `size` words of an array column, none if there are fewer."""
    rest = "".join(f", get({of}, i + {k})" for k in range(1, size))
    return F.expr(f"CASE WHEN size({of}) >= {size} THEN transform(slice({of}, 1, size({of}) - {size - 1}), (x, i) -> xxhash64(x{rest})) ELSE array() END")


def simhash(of: str) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if over half of them have it."""
    ones = f"aggregate({of}, array_repeat(0, 64), (a, h) -> zip_with(a, sequence(0, 63), (n, k) -> n + CAST(shiftright(h, k) & 1 AS INT)))"
    return F.expr(f"aggregate(zip_with({ones}, sequence(0, 63), (n, k) -> IF(2 * n > size({of}), shiftleft(1L, k), 0L)), 0L, (a, b) -> a | b)")


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger counts of the values of two arrays, neither empty.

    Both are sorted into one list, a's before b's of a value; each of b's takes one of a's left over."""
    both = f"array_sort(concat(transform({a}, h -> struct(h, 0 AS side)), transform({b}, h -> struct(h, 1 AS side))))"
    left = "IF(s.h = x.h, s.left, 0)"
    step = f"""IF(x.side = 0, named_struct('h', x.h, 'left', {left} + 1, 'shared', s.shared),
        named_struct('h', x.h, 'left', greatest({left} - 1, 0), 'shared', s.shared + IF({left} > 0, 1, 0)))"""
    shared = f"aggregate({both}, named_struct('h', 0L, 'left', 0, 'shared', 0), (s, x) -> {step}, s -> s.shared)"
    return F.expr(f"transform(array({shared}), s -> s / (size({a}) + size({b}) - s))[0]")


def needed(m: str, similarity: float) -> str:
    return f"CAST(greatest(1, ceil({similarity}D * {m} - 1e-9D)) AS INT)"


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (its own number), item_id, words (of a shingle), m, ihs (shingle hashes), ifp of every different item with words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    hashes = F.coalesce(*[F.when(F.size("w") == k, shingle_hashes("w", k)) for k in range(1, SHINGLE)], shingle_hashes("w"))
    rows = rows.select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("words"), once(hashes).alias("ihs")).distinct()
    rows = rows.select(F.xxhash64("item_id", "ihs").alias("item"), "item_id", "words", F.size("ihs").alias("m"), "ihs", simhash("ihs").alias("ifp"))
    return written(rows, "items")


def _small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows, to be sent to all tasks only if they are counted to be few."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def _bitmap(items: DataFrame) -> Column:
    """array<bigint> constant with a bit for the low bits of each benchmark shingle."""
    hashes = items.select(F.explode("ihs").alias("h"))
    longs = hashes.groupBy(F.expr(f"CAST(shiftright(h, 6) & {BITMAP - 1} AS INT)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits"))
    full = [0] * BITMAP
    for row in longs.collect():  # BITMAP rows at most
        full[row.at] = row.bits
    return F.expr(f"array({', '.join(f'{x}L' if x > -(1 << 63) else '(-9223372036854775807L - 1L)' for x in full)})")


def _hits(hashes: str, bitmap: Column) -> Column:
    """Places of an array of hashes whose bit is set."""

    def hit(h: Column) -> Column:
        return F.get(bitmap, F.shiftright(h, 6).bitwiseAND(BITMAP - 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))) != 0

    return F.filter(F.transform(hashes, lambda h, i: F.when(hit(h), i)), lambda i: i.isNotNull())


#: A document by its doc_id (-1 for none) and a hash of doc_id and text.
DOCUMENT = ["doc_key", "row"]


def _documents(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("doc_key"), F.xxhash64(doc_id, "text").alias("row"), words(F.col("text")).alias("w"))


def candidates(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, doc_key, row, hs of the documents that hold enough benchmark shingles close together."""
    low, high = items.agg(F.min("m"), F.max("m")).first()
    rows = _documents(docs).select("doc_id", *DOCUMENT, once(shingle_hashes("w")).alias("hs"))
    rows = rows.select("doc_id", *DOCUMENT, "hs", once(_hits("hs", _bitmap(items))).alias("hits"))
    least = max(1, -int(-(similarity * (low or 1) - 1e-9) // 1))
    close = F.expr(f"exists(transform(hits, (p, j) -> get(hits, j + {least - 1}) - p < {high or 0}), x -> x)")
    rows = rows.where((F.size("hits") >= least) & close)
    # Repeated rows go; what is left is kept for the later steps, so that texts are read once.
    return written(rows.groupBy(*DOCUMENT).agg(F.any_value("doc_id").alias("doc_id"), F.any_value("hs").alias("hs")), "candidates")


def windows(found: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_key, row, m, start, fp: the windows that can match an item of m shingles."""
    shingles = items.select("m", F.explode("ihs").alias("h")).distinct()
    hits = found.select(*DOCUMENT, F.posexplode("hs").alias("at", "h")).join(_small(shingles), "h")
    # As many places as the text has shingles, at most.
    places = hits.groupBy(*DOCUMENT, "m").agg(F.sort_array(F.collect_set("at")).alias("at"))
    need = needed("m", similarity)
    starts = places.where(f"size(at) >= {need}").select(
        *DOCUMENT, "m", F.expr(f"explode(filter(transform(at, (p, j) -> IF(get(at, j + {need} - 1) - p < m, p, NULL)), p -> p IS NOT NULL))").alias("start")
    )
    cut = starts.join(found, DOCUMENT).select(*DOCUMENT, "m", "start", once(F.expr("slice(hs, start + 1, m)")).alias("hs"))
    return written(cut.select(*DOCUMENT, "m", "start", simhash("hs").alias("fp")), "windows")


def _block(of: str) -> Column:
    return F.expr(f"CAST(shiftright({of}, {BITS} * block) & {(1 << BITS) - 1} AS INT)")


def block_index(items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """item, m, ifp, block, value: items under every value within radius div 4 bits of each of their 4 blocks."""
    near = [v for v in range(1 << BITS) if v.bit_count() <= radius // BLOCKS]
    flips = F.expr("array(" + ", ".join(map(str, near)) + ")")  # 697 values at a radius of 15
    blocks = items.select("item", "m", "ifp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    return blocks.select("item", "m", "ifp", "block", F.explode(flips).alias("flip")).withColumn("value", _block("ifp").bitwiseXOR(F.col("flip"))).drop("flip")


def matches(own: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_key, row, m, start, item: windows and items of one size with fingerprints within the radius."""
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn("value", _block("fp"))
    # Each pair is taken at the first of its blocks that are close enough, so once.
    first = f"array_position(transform(sequence(0, {BLOCKS - 1}), k -> bit_count(shiftright(fp ^ ifp, {BITS} * k) & {(1 << BITS) - 1}) <= {radius // BLOCKS}), true) - 1"
    pairs = own.join(_small(block_index(items, radius)), ["m", "block", "value"]).where(f"bit_count(fp ^ ifp) <= {radius} AND block = {first}")
    return pairs.select(*DOCUMENT, "m", "start", "item")


def _short(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, doc_key, row, item_id, similarity, start of items of fewer than five words."""
    parts = []
    for size in [r.words for r in items.where(F.col("words") < SHINGLE).select("words").distinct().collect()]:  # 4 at most
        own = items.where(F.col("words") == size)
        rows = _documents(docs).select("doc_id", *DOCUMENT, once(shingle_hashes("w", size)).alias("hs"))
        rows = rows.select("doc_id", *DOCUMENT, "hs", F.explode(_hits("hs", _bitmap(own))).alias("start")).withColumn("h", F.expr("hs[start]"))
        known = own.select("item_id", F.col("ihs")[0].alias("h"))
        parts.append(rows.drop("hs").join(_small(known), "h").select("doc_id", *DOCUMENT, "item_id", F.lit(1.0).alias("similarity"), "start"))
    none = _documents(docs).select("doc_id", *DOCUMENT, F.lit(0).cast("long").alias("item_id"), F.lit(1.0).alias("similarity"), F.lit(0).alias("start")).limit(0)
    return reduce(DataFrame.unionByName, parts) if parts else none


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, doc_key, row (hash of doc_id and text), item_id, similarity, start: each document and
    item that match, at the best window."""
    every = items_of(benchmark)
    items = every.where(F.col("words") == SHINGLE)
    found = candidates(docs, items, similarity)
    pairs = matches(windows(found, items, similarity), items, radius)
    both = pairs.join(found, DOCUMENT).join(items.select("item", "item_id", "ihs"), "item")
    both = both.select("doc_id", *DOCUMENT, "item_id", "start", "ihs", once(F.expr("slice(hs, start + 1, m)")).alias("hs"))
    both = both.select("doc_id", *DOCUMENT, "item_id", "start", once(weighted_similarity("ihs", "hs")).alias("similarity")).where(F.col("similarity") >= similarity)
    every = both.unionByName(_short(docs, every))
    best = every.groupBy("doc_id", *DOCUMENT, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    return best.select("doc_id", *DOCUMENT, "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.before")).alias("start"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (in shingles): a row per document and item."""
    best = contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.before")).alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns stay."""
    key, row = unused(docs, "doc_key"), unused(docs, "row")
    doc_id = F.col("doc_id").cast("long")
    bad = written(contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("doc_key").alias(key), F.col("row").alias(row)).distinct(), "contaminated")
    hashed = F.xxhash64(doc_id, "text") == F.col(row)
    return docs.join(_small(bad), (F.coalesce(doc_id, F.lit(-1)) == F.col(key)) & hashed, "left_anti").select(*named(docs))
