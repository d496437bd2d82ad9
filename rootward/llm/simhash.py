"""Near-duplicates by SimHash and anchor-point covering.

Anchors are the code words of the perfect Hamming code [63, 57]: every 63-bit word
lies within its covering radius R = 1 of exactly one anchor. Two fingerprints that
differ in at most t = 2 bits have a word between them that is within t / 2 = 1 of
both, and that word's anchor is within R + t / 2 = 2 of both. So each fingerprint is
replicated to every anchor within distance 2, all of them inside the covering radius
plus the threshold (3): 32 anchors, or 1 if it is a code word itself. That finds every
pair with a twentieth of the copies that the full radius of 3 would take. The last of
the 64 bits takes no part in the choice of anchors, only in the comparison.

A bucket holds distinct fingerprints within distance 2 of its anchor, at most
2 * (1 + 63 + 63 * 31) = 4034, however many documents there are.

`one_of_each` puts a second pass behind the links: texts whose sets of five-word shingles have a
similarity (shared over all shingles) of 0.8 or more belong together as well, however far apart
their fingerprints are. It has three steps.

1. Texts that share a key with one of another component are live. Keys are made of the smallest
   seeded hashes of their shingles (`KEYS` keys of `PER_KEY` hashes); two texts of similarity 0.8
   have none in common with a chance of 7 in 100,000, and only then can a link be missed.
2. Live texts are compared with the most central texts of their keys, those that share most keys with
   others. That joins most of a group of copies by a comparison each. It only saves work: what is
   not joined here is left to the next step.
3. All pairs of live texts in different components, by prefixes: with the shingles of every text in
   one order, frequent ones last, two similar texts share one among the first ninth of the smaller
   and the first fifth of the larger text, and no more than what follows it can be shared beyond. Pairs
   that meet so are few, and each is compared. No pair is left out.

Defined results: a null or empty text, or one of white space only, has the fingerprint
zero and is linked like any other; repeated rows stay; a null doc_id is kept and never
a component id unless nothing else is reachable (then null); other columns are ignored by
`near_duplicates` and kept by `one_of_each`, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootward.llm.common import batches, connected_components, named, sized, small_batches, small_or_shuffled, texts, unused, written

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: The second pass: words of a shingle, the least similarity, keys of a text and hashes of a key.
WIDE_SHINGLE, SIMILARITY, KEYS, PER_KEY = 5, 0.8, 24, 5
#: Central texts of a key that its texts are compared with, one after the other.
PIVOTS = 3
#: Shingles are counted in so many classes, to put frequent ones last.
CLASSES = 1 << 18
#: Up to so many rows of keys or texts are told to all tasks.
FEW = 1_000_000
#: The bits of each byte value, most significant first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
ONE = np.uint64(1)


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of a text in order, repeats included; fewer words: of all of them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_of(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1))
    return np.fromiter((hash_of(joined[a:z], seed) for a, z in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, each occurrence counted."""
    hashes = shingle_hashes(text, size, seed)
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    as_bytes = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    if n < 200:
        ones = BITS[as_bytes].sum(axis=0).ravel()
    else:
        ones = np.concatenate([np.bincount(as_bytes[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(schema, ([b.column("doc_id"), np.array([fingerprint(x) for x in texts(b)], np.uint64).view(np.int64)] for b in parts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _anchor_masks() -> np.ndarray:
    """By syndrome: what to flip to reach each anchor within distance 2 (zero syndrome: nothing)."""
    masks = np.zeros((64, 32), np.uint64)
    for s in range(1, 64):
        pairs = [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 64) if a < a ^ s]
        masks[s] = [1 << (s - 1), *pairs]
    return masks


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, anchor) of every anchor within distance 2 of each fingerprint."""
    words = fp & np.uint64((1 << 63) - 1)
    syndrome = np.zeros(len(fp), np.int64)
    for j in range(6):
        check = np.uint64(sum(1 << (a - 1) for a in range(1, 64) if a >> j & 1))
        syndrome |= (np.bitwise_count(words & check).astype(np.int64) & 1) << j
    to = words[:, None] ^ _anchor_masks()[syndrome]
    real = np.ones(to.shape, bool)
    real[syndrome == 0, 1:] = False
    return np.nonzero(real)[0], to[real]


def _stars(members: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Links that connect what direct links within one anchor connect: at most one less than members, each
    to the smallest (as a signed long) of those connected, so that anchors tell the same links and few rounds follow."""
    rest = np.sort(members.view(np.int64)).view(np.uint64)
    while len(rest):
        first, stack, rest = rest[0], [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            for y in rest[near]:
                yield int(first), int(y)
            stack.extend(rest[near])
            rest = rest[~near]


def links_of_sorted(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal anchors."""
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    size = np.diff(edge)
    two = edge[:-1][size == 2]
    close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold]
    found = [(int(x), int(y)) for a, n in zip(edge[:-1][size > 2], size[size > 2], strict=True) for x, y in _stars(fp[a : a + n], threshold)]
    more = np.array(found, np.uint64).reshape(-1, 2)
    return np.concatenate((fp[close], more[:, 0])), np.concatenate((fp[close + 1], more[:, 1]))


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within the threshold."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")
    to_anchor = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
    to_link = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def replicate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            at, anchor = anchors(fp)
            yield from batches(to_anchor, [[anchor.view(np.int64), fp[at].view(np.int64)]])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = fp = np.zeros(0, np.uint64)
        for b in parts:
            anchor = np.concatenate((anchor, b.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)))
            fp = np.concatenate((fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            keep = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if len(anchor) and anchor[0] != anchor[-1] else 0
            if keep:
                x, y = links_of_sorted(anchor[:keep], fp[:keep], threshold)
                yield from batches(to_link, [[x.view(np.int64), y.view(np.int64)]])
                anchor, fp = anchor[keep:], fp[keep:]
        if len(anchor):
            x, y = links_of_sorted(anchor, fp, threshold)
            yield from batches(to_link, [[x.view(np.int64), y.view(np.int64)]])

    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def _rooted(prints: DataFrame, threshold: int) -> DataFrame:
    """fp, first (smallest doc_id with it), root (a fingerprint that stands for its component) of all distinct fingerprints."""
    distinct = written(sized(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), prints.count()), "distinct-fingerprints")
    rows = distinct.count()
    found = connected_components(links(distinct, threshold), "a", "b", rows)
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return written(sized(rooted, rows), "rooted")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most threshold bits reach."""
    prints = written(fingerprints(docs), "fingerprints")
    rows, rooted = prints.count(), _rooted(prints, threshold)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = written(sized(rooted.join(smallest, "root").select("fp", "component_id"), rows), "components")
    return sized(prints.join(by_print, "fp").select("doc_id", "fp", "component_id"), rows)


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 64, KEYS * PER_KEY, dtype=np.uint64) | ONE, r.integers(0, 1 << 64, KEYS * PER_KEY, dtype=np.uint64)


def smallest_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each of KEYS * PER_KEY seeded orders the smallest hash of a set that is not empty."""
    factor, mask = _multipliers()
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024, None] ^ mask) * factor).min(axis=0), out=least)
    return least


def keys_of(text: str) -> list[int]:
    """The keys of a text for the second pass, its own number in front; none for texts of one shingle or less."""
    hashes = np.unique(shingle_hashes(text, WIDE_SHINGLE))
    if len(hashes) < 2:
        return []
    least = smallest_hashes(hashes).reshape(KEYS, PER_KEY)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)]
    return np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED), *keys], np.uint64).view(np.int64).tolist()


def _version() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _texts_with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of doc_id and text), fp, keys of every row."""
    small_batches(docs.sparkSession)
    ints = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fp", pa.int64()), ("keys", ints)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            own = texts(b)
            prints = np.array([fingerprint(x) for x in own], np.uint64).view(np.int64)
            yield from batches(schema, [[b.column("doc_id"), b.column("version"), prints, [keys_of(x) for x in own]]])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"), "text")
    return slim.mapInArrow(run, "doc_id long, version long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, hashes: the distinct shingle hashes of texts; wanted: text and the version of a row that has it."""
    schema = pa.schema([("text", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [np.unique(shingle_hashes(x, WIDE_SHINGLE)).view(np.int64) for x in texts(b, "body")]
            yield from batches(schema, [[b.column("text"), found]])

    bodies = docs.select(_version().alias("version"), F.col("text").alias("body"))
    rows = bodies.join(small_or_shuffled(wanted, FEW), "version").select("text", "body")
    return rows.mapInArrow(run, "text long, hashes array<long>").dropDuplicates(["text"])


def _live_keys(known: DataFrame) -> DataFrame:
    """key, text, central: keys that texts of two components have, with the number of texts that a text
    meets under all of its keys."""
    held = known.select(F.explode("keys").alias("key"), "text", "root")
    counts = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    counts = written(counts.where("low < high").select("key", "n"), "live-keys")
    held = written(held.join(small_or_shuffled(counts, FEW), "key").select("key", "text", "n"), "held")
    central = held.groupBy("text").agg(F.sum("n").alias("central"))
    return written(held.select("key", "text").join(central, "text"), "live")


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (text, other, a, b) that are similar, as links (a, b) between their components; links may repeat."""
    both = pairs.join(sets.toDF("other", "of_other"), "other").join(sets, "text")
    shared = F.size(F.array_intersect("hashes", "of_other"))
    near = both.where(shared >= similarity * (F.size("hashes") + F.size("of_other") - shared) - 1e-9)
    return written(near.select("a", "b"), "similar-roots")


def prefix_lengths(n: int, similarity: float) -> tuple[int, int]:
    """How many of n shingles, in a common order, hold one that is shared with a similar text of at
    least n shingles, and with any similar text."""
    least = 2 * similarity / (1 + similarity)
    return n - math.ceil(least * n - 1e-9) + 1, n - math.ceil(similarity * n - 1e-9) + 1


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """shingle, text, n, place, small: the first shingles of every set, small where they count for the smaller text."""
    counted = sets.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(CLASSES - 1).alias("class")).count().toArrow()
    frequent = np.zeros(CLASSES, np.int64)
    frequent[counted.column("class").to_numpy()] = counted.column("count").to_numpy()
    longs, i = pa.int64(), pa.int32()
    schema = pa.schema([("shingle", longs), ("text", longs), ("n", i), ("place", i), ("small", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [[] for _ in schema]
            for text, hashes in zip(b.column("text").to_pylist(), b.column("hashes"), strict=True):
                h = hashes.values.to_numpy(zero_copy_only=False)
                own, any_size = prefix_lengths(len(h), similarity)
                first = h[np.lexsort((h, frequent[h & (CLASSES - 1)]))[:any_size]]
                place = np.arange(len(first), dtype=np.int32)
                for c, x in zip(found, (first, np.full_like(first, text), np.full_like(place, len(h)), place, place < own), strict=True):
                    c.append(x)
            yield from batches(schema, [[np.concatenate(c) for c in found]] if found[0] else [])

    return sets.mapInArrow(run, "shingle long, text long, n int, place int, small boolean")


def _prefix_pairs(prefixes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """text, other, a, b: pairs of texts in different components (a, b) that may be similar."""
    rows = written(prefixes.join(small_or_shuffled(roots, FEW), "text"), "prefixes")
    one = rows.where("small").select("shingle", *[F.col(c).alias(f"{c}_1") for c in ("text", "root", "n", "place")])
    two = rows.select("shingle", *[F.col(c).alias(f"{c}_2") for c in ("text", "root", "n", "place")])
    ordered = (F.col("n_1") < F.col("n_2")) | (F.col("n_1") == F.col("n_2")) & (F.col("text_1") < F.col("text_2"))
    rest = F.least(F.col("n_1") - F.col("place_1"), F.col("n_2") - F.col("place_2"))
    enough = rest >= F.lit(similarity / (1 + similarity)) * (F.col("n_1") + F.col("n_2")) - 1e-9
    pairs = one.join(two, (one.shingle == two.shingle) & (F.col("root_1") != F.col("root_2")) & ordered & enough)
    return pairs.select(F.col("text_1").alias("text"), F.col("text_2").alias("other"), F.col("root_1").alias("a"), F.col("root_2").alias("b")).distinct()


def similar_roots(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): roots of fingerprint components that belong together, since texts of both are
    similar, each with the smallest of its group.

    found: version, root and keys of every row. Texts of one component need no comparison, and
    components grow from step to step."""
    known = found.where("size(keys) > 0").groupBy(F.col("keys")[0].alias("text")).agg(F.min(F.struct("version", "root", "keys")).alias("x"))
    known = written(known.select("text", "x.version", "x.root", F.slice("x.keys", 2, KEYS).alias("keys")), "texts")
    # Texts of the same shingles in another order may have other fingerprints.
    same = found.where("size(keys) > 0").select(F.col("keys")[0].alias("text"), F.col("root").alias("b")).distinct()
    joined = written(same.join(same.groupBy("text").agg(F.min("b").alias("a")), "text").where("a <> b").select("a", "b"), "similar-roots")
    components = connected_components(joined, "a", "b")
    live = _live_keys(known)
    texts_of = written(known.join(live.select("text").distinct(), "text", "left_semi").select("text", "version", "root"), "live-texts")
    sets = written(_sets(docs, texts_of.select("text", "version")), "sets")

    def roots() -> DataFrame:
        return texts_of.join(components, texts_of.root == components.node, "left").select("text", F.coalesce(components.root, texts_of.root).alias("root"))

    def joined_with(links: DataFrame) -> DataFrame:
        return connected_components(components.toDF("a", "b").unionByName(links), "a", "b")

    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("central"), "text"))
    pivots = written(live.withColumn("turn", first).where(F.col("turn") <= PIVOTS).select("key", "turn", F.col("text").alias("other"), "central"), "pivots")
    # The most central text of a key joins most of its group, the next ones what that one left.
    for turns in ((1,), tuple(range(2, PIVOTS + 1))):
        now = written(roots(), "roots")
        central = pivots.where(F.col("turn").isin(*turns)).join(now.toDF("other", "b"), "other").select("key", "turn", "central", "other", "b")
        met = live.select("key", "text").join(central, "key").join(now.withColumnRenamed("root", "a"), "text").where("a <> b")
        pairs = met.groupBy("text", "turn").agg(F.max(F.struct("central", "other", "a", "b")).alias("x")).select("text", "x.other", "x.a", "x.b").distinct()
        components = joined_with(_near(pairs, sets, similarity))
    pairs = written(_prefix_pairs(_prefixes(sets, similarity), written(roots(), "roots"), similarity), "pairs")
    return joined_with(_near(pairs, sets, similarity))


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: links of fingerprints and of the second pass.

    The row with the smallest doc_id of the group stays (a row without one only if no other has
    one); rows that share it, with other texts, by a hash of the text. Rows of one doc_id whose
    texts are in different groups are different documents: each may stay for its own group. Of
    rows equal in doc_id and text the one whose columns, as JSON, come first stays."""
    rows = written(_texts_with_keys(docs), "fingerprints")
    by_print = rows.join(_rooted(rows, threshold).select("fp", "root"), "fp")
    by_print = written(by_print.select("doc_id", "version", "root", "keys"), "groups")
    joined = similar_roots(docs.select("doc_id", "text"), by_print, similarity).toDF("root", "wide")
    grouped = by_print.join(joined, "root", "left").select("doc_id", "version", F.coalesce("wide", "root").alias("root"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("x")
    kept = grouped.groupBy("root").agg(best).select(F.col("x.doc_id").alias("kept_id"), F.col("x.version").alias("kept_version")).distinct()
    repeats = grouped.groupBy(F.col("doc_id").alias("kept_id"), F.col("version").alias("kept_version")).agg(F.count("*").alias("kept_rows"))
    same = kept.kept_id.eqNullSafe(repeats.kept_id) & (kept.kept_version == repeats.kept_version)
    kept = written(kept.join(repeats, same).select(kept.kept_id, kept.kept_version, "kept_rows"), "kept")
    version, doc_id = unused(docs, "version"), F.col("doc_id").cast("long")
    hashed = docs.withColumn(version, F.xxhash64(doc_id, "text"))

    def those(which: str) -> DataFrame:
        ids = kept.where(which).select(F.col("kept_id").alias(unused(hashed, "kept_id")), F.col("kept_version").alias(unused(hashed, "kept_version")))
        return hashed.join(ids, doc_id.eqNullSafe(ids[ids.columns[0]]) & (F.col(version) == ids[ids.columns[1]]), "left_semi")

    whole = F.struct(*named(docs))
    one = those("kept_rows > 1").groupBy("doc_id", version).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return those("kept_rows = 1").select(*named(docs)).unionByName(one.select("row.*"))
