"""Removal of repeated byte strings, by suffix arrays in linear grouping construction.

A byte goes if a string of `LENGTH` bytes that covers it starts anywhere else as well.

1. Anchors. A text's grams of `GRAM` bytes are hashed; of every `SPAN` grams in a row the
   one with the smallest hash is an anchor. A string of LENGTH = GRAM + SPAN - 1 bytes has
   exactly SPAN grams, so equal strings have an anchor at the same place, whatever is
   around them. The context of an anchor is SPAN - 1 bytes to either side of its gram: every
   string that has this anchor lies in it.
2. Groups. Anchors with equal grams meet (a hash of the gram as the key, sorted within
   partitions, read as a stream, so a group's size needs no memory). Grams and contexts
   that a part of the documents shows to be frequent are known to repeat, and their anchors
   are dealt out over the partitions by context or row. Where a whole
   context repeats, all of it is covered. What is left are contexts that differ from all
   others of their group, and one copy of each context that repeats beside them.
3. Suffix arrays. The bytes of those contexts are fetched. A group is put in one string, its
   common gram a single symbol, and so is every stretch of bytes inside which no context
   parts from another; bytes that no other context shares are left out. A suffix array
   tells which strings of LENGTH bytes repeat: neighbours in it that agree that far. Groups
   of more than `CAP` contexts would be large tasks; they are divided first. Strings with at
   most half of their other bytes before the gram share the gram and half of the bytes behind
   it, and the rest share half of those before it: two groups by gram and shared bytes, of
   shorter contexts. Contexts that became equal are counted before the shuffle, and one of
   them goes on. A group is halved again while it is too large, at most 7 times, after which
   its contexts are equal.
4. Spans of all steps are joined to the texts and cut out.

The suffix array is built by grouping (Baier 2016): suffixes are grouped by their first
symbol; groups are gone through in descending order; each suffix of a group looks for the
previous suffix of a smaller group, which takes the group's string on to its own prefix and
so moves to a new group behind its old one. In the end each group shares one Lyndon
prefix, and the suffixes are emitted in order along the same pointers.

Keys and context hashes are 64 bits each, both must agree; spans find their text by doc_id and
a hash of it. Defined results: a null or empty
text has no bytes; repeated rows repeat each other's strings, and all of them go; texts
under LENGTH bytes stay; texts of any length are taken whole; a null doc_id is kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import batches, small_batches, texts, written

LENGTH, GRAM = 200, 120
SPAN = LENGTH - GRAM + 1
#: Contexts of one group that are sorted in one task, and bytes of contexts sorted at once.
CAP, TOGETHER = 2000, 200_000
#: Frequent: one of SHARES or more of the anchors of one document in ONE_IN, at least LEAST anchors.
SHARES, ONE_IN, LEAST = 2000, 16, 64
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any part of a byte string, equal for equal parts wherever they lie."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(INVERSE, n), dtype=np.uint64)))
        self.power = _powers(BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.power[start])


def _sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over each run of `width` values, by doubling."""
    step = 1
    while step * 2 <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and context hashes of a text's anchors."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    least = _sliding(np.minimum, grams, SPAN)
    edge = np.zeros(SPAN - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), SPAN) == grams)
    low, high = np.maximum(place - (SPAN - 1), 0), np.minimum(place + GRAM + SPAN - 1, n)
    shape = ((place - low) * SPAN + (high - place - GRAM)).astype(np.uint64)
    return place, grams[place], _mixed(hashes.of(low, high) ^ (shape * MIX))


def suffix_array(text: np.ndarray) -> list[int]:
    """Suffix array of whole numbers of which the last one is smallest and occurs once."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    values = text[order]
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    size_of = np.diff(np.append(begin, n))
    group = np.empty(n, np.int64)  # a group's name is the number of suffixes before it
    group[order] = np.repeat(begin, size_of)
    group = group.tolist()
    members = {int(b): order[b : b + s].tolist() for b, s in zip(begin, size_of, strict=True)}
    size = dict(zip(begin.tolist(), size_of.tolist(), strict=True))
    begin_of_end = {b + s - 1: b for b, s in size.items()}
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        own = begin_of_end[end]
        times: dict[int, int] = {}
        for i in sorted(x for x in members.pop(own) if group[x] == own):
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            split: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                split.setdefault((k, group[j]), []).append(j)
            for k, old in sorted(split, reverse=True):
                moved, count = split[k, old], size[old]
                if len(moved) == count:
                    continue
                new = old + count - len(moved)
                size[old], size[new] = count - len(moved), len(moved)
                begin_of_end[old + count - 1] = new
                begin_of_end[new - 1] = old
                members[new] = moved
                for j in moved:
                    group[j] = new
        end = own - 1
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def shared_lengths(groups: list[int], parts: list[bytes]) -> list[list[int]]:
    """For each part, ascending: every length of a prefix that it shares with another part
    of its group and that is the longest for some part."""
    order = sorted(range(len(parts)), key=lambda i: (groups[i], parts[i]))
    size = np.array([len(parts[i]) for i in order])
    table = np.zeros((len(parts), SPAN - 1), np.uint8)
    table[np.arange(SPAN - 1) < size[:, None]] = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN - 1)
    own = np.array([groups[i] for i in order])
    common = np.where(own[1:] == own[:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), 0).tolist()
    out: list[list[int]] = [[] for _ in parts]
    for places, near in ((order, common), (order[::-1], common[::-1])):
        lowest: list[int] = []  # the least common lengths on the way to the parts gone through
        for i, c in zip(places, [0, *near]):
            while lowest and lowest[-1] > c:
                lowest.pop()
            if c and (not lowest or lowest[-1] != c):
                lowest.append(c)
            out[i] += lowest
    return [sorted(set(x)) for x in out]


def repeated_in(contexts: list[tuple[int, bytes, bytes]]) -> list[list[tuple[int, int]]]:
    """For contexts (group, left, right): ranges (from, to) of left lengths such that another
    context of the group has the string that begins there.

    Bytes between two lengths at which a context parts from others make one symbol, since
    whoever has the first of them has all. What no other context shares is left out."""
    if not contexts:
        return []
    numbers: dict[int, int] = {}
    groups = [numbers.setdefault(c[0], len(numbers)) for c in contexts]
    lefts = shared_lengths(groups, [c[1][::-1] for c in contexts])
    rights = shared_lengths(groups, [c[2] for c in contexts])
    names: dict[tuple, int] = {}
    symbols, owner, low, high = [], [], [], []  # low > high: no string begins here
    first_right = [0] * len(contexts)
    for i, (group, (_, left, right)) in enumerate(zip(groups, contexts, strict=True)):
        before, after = lefts[i], rights[i]
        if sum(before[-1:]) + sum(after[-1:]) < SPAN - 1:
            continue
        began = len(symbols)
        for c, shorter in zip(reversed(before), [*before[-2::-1], 0]):
            symbols.append(names.setdefault((group, left[len(left) - c :], None), len(names) + 2))
            low.append(shorter + 1)
            high.append(c)
        symbols.append(names.setdefault((group, None, None), len(names) + 2))
        low.append(0)
        high.append(0)
        first_right[i] = len(symbols)
        for c in after:
            symbols.append(names.setdefault((group, None, right[:c]), len(names) + 2))
            low.append(SPAN)
            high.append(c)
        symbols.append(1)
        low.append(SPAN)
        high.append(0)
        owner += [i] * (len(symbols) - began)
    symbols.append(0)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if not owner:
        return out
    text, sa = np.array(symbols, np.int64), np.array(suffix_array(np.array(symbols, np.int64))[1:], np.int64)
    owners, lows, highs, right_of = np.array(owner), np.array(low), np.array(high), np.array(first_right)
    pair = np.flatnonzero((text[sa[1:]] == text[sa[:-1]]) & (lows[sa[1:]] < SPAN))
    a, b = right_of[owners[sa[pair]]], right_of[owners[sa[pair + 1]]]
    common, open_ = np.zeros(len(pair), np.int64), np.arange(len(pair))
    while len(open_):  # at most SPAN times
        x = text[a[open_]]
        open_ = open_[(x == text[b[open_]]) & (x > 1)]
        common[open_] = highs[a[open_]]
        a[open_] += 1
        b[open_] += 1
    most = np.full(len(sa), -1)
    np.maximum.at(most, pair, common)
    np.maximum.at(most, pair + 1, common)
    start = np.maximum(lows[sa], SPAN - 1 - most)
    for i, lo, hi in zip(*(x[(most >= 0) & (start <= highs[sa])].tolist() for x in (owners[sa], start, highs[sa])), strict=True):
        out[i].append((lo, hi))
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(starts) else ends


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: A text: its doc_id (-1 for none) and a hash of doc_id and text, which tells apart what repeats a doc_id.
ROW = ["doc_key", "row"]


def _row_key() -> list:
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(-1)).alias("doc_key"), F.xxhash64(doc_id, "text").alias("row")]


def all_anchors(docs: DataFrame) -> DataFrame:
    """doc_key, row, place, key, context: every anchor of every text."""
    schema = pa.schema([("doc_key", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("context", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in ROW)
            for doc, row, text in zip(ids, rows, texts(b), strict=True):
                place, key, context = anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
                if len(place):
                    yield from batches(schema, [[np.full(len(place), doc), np.full(len(place), row), place.astype(np.int32), _signed(key), _signed(context)]])

    return docs.where(F.octet_length("text") >= LENGTH).select(*_row_key(), "text").mapInArrow(run, "doc_key long, row long, place int, key long, context long")


def frequent(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST) -> DataFrame:
    """key, context, n, of_key, doc_key, row, place: grams and contexts that hold a large share of the
    anchors of one document in `one_in` (picked by hash), each with one of its anchors.

    Only how rows are dealt out depends on it. No more than 2 * SHARES rows."""
    picked = all_anchors(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0))
    pairs = written(picked.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("first")), "sample")
    enough = max(least, (pairs.agg(F.sum("n")).first()[0] or 0) // SHARES)
    keys = pairs.groupBy("key").agg(F.sum("n").alias("of_key")).where(F.col("of_key") >= enough)
    hot = pairs.where(F.col("n") >= enough).select("key", "context", "n", "first.*")
    return written(keys.join(hot, "key", "left").select("key", "context", "n", "of_key", *ROW, "place"), "frequent")


def dealt(found: DataFrame, hot: DataFrame) -> DataFrame:
    """found with `kind` (0; 1 for a frequent gram; 2 for a frequent context) and `deal`: anchors
    of a frequent gram are dealt out by context, and those of a frequent context by row."""
    keys = hot.select("key").distinct().withColumn("of_key", F.lit(1))
    pairs = hot.where("context IS NOT NULL").select("key", "context").withColumn("of_pair", F.lit(1))
    kind = F.coalesce("of_key", F.lit(0)) + F.coalesce("of_pair", F.lit(0))
    found = found.join(F.broadcast(keys), "key", "left").join(F.broadcast(pairs), ["key", "context"], "left").withColumn("kind", kind)
    deal = F.when(F.col("kind") == 2, F.xxhash64("row", "place")).when(F.col("kind") == 1, F.col("context")).otherwise(0)
    return found.select(*ROW, "place", "key", "context", "kind", deal.alias("deal"))


def classified(found: DataFrame) -> DataFrame:
    """doc_key, row, place, key, whole: anchors, as dealt() gives them, whose gram repeats. whole: the
    context repeats; `shown`: its bytes are wanted, since contexts of its group differ
    (one of each frequent context is to be added)."""
    out = "doc_key long, row long, place int, key long, whole boolean, shown boolean"
    schema = pa.schema([("doc_key", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("whole", pa.bool_()), ("shown", pa.bool_())])

    def settled(key: np.ndarray, context: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, kind: np.ndarray, edge: tuple) -> list:
        """Rows of a stretch of sorted anchors; edge: whether key and context go on before and behind it,
        and whether the key's contexts differ from those outside."""
        same_key = np.concatenate(([edge[0]], key[1:] == key[:-1], [edge[1]]))
        same = np.concatenate(([edge[2]], (key[1:] == key[:-1]) & (context[1:] == context[:-1]), [edge[3]]))
        again, whole = same_key[:-1] | same_key[1:], same[:-1] | same[1:]
        first = ~same[:-1]
        group = np.cumsum(~same_key[:-1])
        kinds = np.bincount(group, first)
        shown = first & again & ((kinds[group] > 1) | ~whole)
        on = (group == 0) & edge[0] | (group == group[-1]) & edge[1]  # a group that goes on elsewhere: take its contexts as different
        shown |= first & again & on
        # Frequent grams and contexts repeat in any case; others of theirs are elsewhere.
        again, whole = again | (kind > 0), whole | (kind == 2)
        shown = np.where(kind > 0, first & (kind == 1), shown)
        return [doc[again], row[again], place[again], key[again], whole[again], shown[again]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        before: tuple[int, int] | None = None
        for b in parts:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "context", *ROW, "place", "kind")]
            if held is not None:
                key, context = held[0], held[1]
                edge = (
                    before is not None and before[0] == key[0], key[-1] == now[0][0],
                    before is not None and before == (key[0], context[0]), (key[-1], context[-1]) == (now[0][0], now[1][0]),
                )
                yield from batches(schema, [settled(*held, edge)])
                before = (key[-1], context[-1])
            held = now
        if held is not None:
            key, context = held[0], held[1]
            edge = (before is not None and before[0] == key[0], False, before is not None and before == (key[0], context[0]), False)
            yield from batches(schema, [settled(*held, edge)])

    rows = found.repartition("key", "deal").sortWithinPartitions("key", "context")
    return rows.select("key", "context", *ROW, "place", "kind").mapInArrow(run, out)


def contexts(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """key, doc_key, row, place, left, right: the bytes beside the grams of anchors."""
    schema = pa.schema([("key", pa.int64()), ("doc_key", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
    # A text's own anchors: no more than it has bytes.
    wanted = shown.groupBy(*ROW).agg(F.collect_set(F.struct("place", "key")).alias("wanted"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            columns: list[list] = [[], [], [], [], [], []]
            for doc, row, text, own in zip(*(b.column(c).to_pylist() for c in ROW), texts(b), b.column("wanted").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in own:
                    p = x["place"]
                    for c, v in zip(columns, (x["key"], doc, row, p, data[max(0, p - SPAN + 1) : p], data[p + GRAM : p + GRAM + SPAN - 1]), strict=True):
                        c.append(v)
            yield from batches(schema, [columns])

    rows = docs.where(F.octet_length("text") >= LENGTH).select(*_row_key(), "text").join(wanted, ROW)
    return rows.mapInArrow(run, "key long, doc_key long, row long, place int, left binary, right binary")


def spans_by_suffix_array(found: DataFrame) -> DataFrame:
    """doc_key, row, start, end of strings that repeat within groups of contexts."""
    schema = pa.schema([("doc_key", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def solve(pending: list[tuple]) -> list:
        hits = repeated_in([(k, left, right) for k, _, _, _, left, right in pending])
        rows = [(doc, row, place - hi, place - lo + LENGTH) for (_, doc, row, place, _, _), own in zip(pending, hits, strict=True) for lo, hi in own]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        symbols = 0
        for b in parts:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", *ROW, "place", "left", "right")), strict=True):
                if symbols > TOGETHER and pending[-1][0] != x[0]:
                    yield from batches(schema, [solve(pending)])
                    pending, symbols = [], 0
                pending.append(x)
                symbols += len(x[4]) + len(x[5]) + 2
        if pending:
            yield from batches(schema, [solve(pending)])

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_key long, row long, start int, end int")


def halves(groups: DataFrame) -> DataFrame:
    """key, low, high, doc_key, row, place, left, right: contexts of groups of strings with `low` to `high`
    bytes before the gram, in two groups each. key: gram, range and the bytes that all share."""
    middle = F.expr("CAST((low + high) div 2 AS int)")
    two = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))
    each = groups.select("key", *ROW, "place", "left", "right", F.explode(two).alias("half")).select("key", *ROW, "place", "left", "right", "half.*")
    each = each.where(f"octet_length(left) >= low AND octet_length(right) >= {SPAN - 1} - high")
    key = F.expr(f"xxhash64(key, low, high, substring(left, -low, low), substring(right, 1, {SPAN - 1} - high))")
    left, right = F.expr("substring(left, -high, high)"), F.expr(f"substring(right, 1, {SPAN - 1} - low)")
    return each.select(key.alias("key"), "low", "high", *ROW, "place", left.alias("left"), right.alias("right"))


def divided(groups: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """For contexts (key, doc_key, row, place, left, right) of groups that are too large to sort in one task:
    contexts of groups of `cap` at most, and doc_key, row, start, end of what is known to repeat."""
    equal = ["key", "low", "high", "left", "right"]
    small = groups.where("false")
    spans = groups.where("false").selectExpr(*ROW, "place AS start", "place AS end")
    groups = written(groups.selectExpr("key", "0 AS low", f"{SPAN - 1} AS high", *ROW, "place", "left", "right"), "group")
    while not groups.isEmpty():
        each = halves(groups)
        kinds = written(each.groupBy(equal).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("first")), "kinds")
        hits = each.join(kinds.where("n > 1").select(equal), equal)
        least, most = f"greatest(low, {SPAN - 1} - octet_length(right))", "least(high, octet_length(left))"
        spans = spans.unionByName(hits.selectExpr(*ROW, f"place - {most} AS start", f"place - {least} + {LENGTH} AS end"))
        sizes = kinds.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        rest = written(kinds.join(sizes, "key").select("key", "low", "high", "first.*", "left", "right", "size"), "group")
        small = small.unionByName(rest.where(F.col("size") <= cap).select(small.columns))
        groups = rest.where(F.col("size") > cap).drop("size")
    return small, spans


def repeated_spans(docs: DataFrame, cap: int = CAP, one_in: int = ONE_IN, least: int = LEAST) -> DataFrame:
    """doc_key, row (doc_id and a hash of it and the text), start, end: spans of bytes, overlapping ones included."""
    small_batches(docs.sparkSession)
    hot = frequent(docs, one_in, least)
    found = written(classified(dealt(all_anchors(docs), hot)), "anchors")
    whole = found.where("whole").selectExpr(*ROW, f"place - {SPAN - 1} AS start", f"place + {LENGTH} AS end")
    shown = found.where("shown").select(*ROW, "place", "key").unionByName(hot.where("context IS NOT NULL").select(*ROW, "place", "key"))
    bytes_of = written(contexts(docs, shown), "contexts")
    counts = bytes_of.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    large = written(counts.where(F.col("n") > cap).select("key"), "large-groups")
    small = bytes_of.join(F.broadcast(large) if large.limit(10_001).count() <= 10_000 else large, "key", "left_anti")
    parts, equal = divided(bytes_of.join(large, "key", "left_semi"), cap)
    return whole.unionByName(spans_by_suffix_array(small.unionByName(parts))).unionByName(equal)


def removed(docs: DataFrame, spans: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (what is left, as bytes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    schema = schema.append(pa.field("kept", pa.binary())) if with_kept else schema
    own = spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # within one text

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for text, found in zip(texts(b), b.column("spans"), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, n = data, 0
                if found.is_valid:
                    starts, ends = (found.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                    starts, ends = merged(np.maximum(starts, 0), np.minimum(ends, len(data)))
                    cuts, n = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(data)], len(starts)
                    kept = b"".join(data[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))
                rows.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept)[: len(schema) - 1])
            yield from batches(schema, [[b.column("doc_id"), *map(list, zip(*rows, strict=True))]] if rows else [])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_row_key()).join(own, ROW, "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return rows.select("doc_id", "text", "spans").mapInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return removed(docs, written(repeated_spans(docs), "spans"), with_kept=False)
