"""Fill-in-middle texts, put together by a secondary sort.

A text is a row of units: runs of ASCII letters, and every other character. Two draws from the
doc_id cut it into prefix, middle and suffix, and the text is given out in the order prefix,
suffix, middle (psm), in the order suffix, prefix, middle (spm), or as it is (plain), with a mark
before each section.

Tasks that read a text emit pieces: runs of whole units of a section, at most `CHUNK` characters
each (a longer unit is divided), keyed by document and place in the output. One
`repartitionAndSortWithinPartitions` brings the pieces of a document together in the order of the
output, and they stream into a digest; no output is put together to hash it. The restoration reads
that stream as anybody would who has the output and the form only: it finds the marks, emits
pieces keyed by document and place in the text, and sorts again. Documents stay in their
partition, so the second sort moves nothing; both sorts spill to disk by themselves.

A key holds hashes of doc_id and text and the number of the partition a row was read in. Rows that
agree in all of it are equal rows: their pieces lie side by side, the stream takes the first of each
place and gives the result once for each row.

Defined results: a null text counts as empty, and an empty one is plain; a null doc_id draws from
`1:` alone; repeated rows are each given back; an empty table gives an empty result; a text that
holds a mark is plain. Letters are those of ASCII only. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Characters of a piece, and of a block of a text that is looked at at once.
CHUNK, BLOCK = 16_384, 1 << 20
#: Bytes of text that a partition gets on average.
PARTITION_BYTES = 64 << 20
#: Of 100 draws, those below are not plain; of 100 further ones, those below are spm.
NOT_PLAIN, SPM = 90, 20
#: The order of sections in the output; 0 prefix, 1 middle, 2 suffix.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK_OF = (PREFIX, MIDDLE, SUFFIX)


def unit_starts(text: str) -> np.ndarray:
    """Where the units of a text begin, in code points."""
    found, letter_before = [], False
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = points | 32
        letter = (low >= 97) & (low <= 122) & (points < 128)
        begins = ~(letter & np.concatenate(([letter_before], letter[:-1])))
        found.append(np.flatnonzero(begins) + at)
        letter_before = bool(letter[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plan(doc_id: int | None, text: str, starts: np.ndarray) -> tuple[str, int, int]:
    """Form of a text and the two places, in code points, that it is cut at."""
    h1, h2, h3, h4 = draws(doc_id)
    n = len(starts)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= NOT_PLAIN:
        return "plain", len(text), len(text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda unit: int(starts[unit]) if unit < n else len(text)
    return "spm" if h4 % 100 < SPM else "psm", place(first), place(second)


def pieces_of(text: str, starts: np.ndarray, begin: int, end: int) -> Iterator[str]:
    """Runs of whole units between two places, of at most CHUNK characters."""
    while begin < end:
        stop = min(begin + CHUNK, end)
        if stop < end:
            last = int(starts[np.searchsorted(starts, stop, "right") - 1])
            stop = last if last > begin else stop
        yield text[begin:stop]
        begin = stop


def output_pieces(text: str, starts: np.ndarray, form: str, first: int, second: int) -> Iterator[str]:
    """The output of a text in its order, a mark being a piece of its own."""
    if form == "plain":
        yield from pieces_of(text, starts, 0, len(text))
        return
    bounds = ((0, first), (first, second), (second, len(text)))
    for section in ORDERS[form]:
        yield MARK_OF[section]
        yield from pieces_of(text, starts, *bounds[section])


class Restorer:
    """Reads an output in pieces of any size and tells (section, piece) of the text behind it.

    No section holds a mark, marks begin with the only `<` in them and end with a character that
    begins none, so the first place where the next mark reads is the mark itself. Two characters
    are held back, as a mark may go on in the next piece."""

    def __init__(self, form: str):
        self.left = [(s, MARK_OF[s]) for s in ORDERS.get(form, ())]
        self.section, self.held = 0, ""

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        self.held += piece
        while self.left and (at := self.held.find(self.left[0][1])) >= 0:
            if at:
                yield self.section, self.held[:at]
            self.section, mark = self.left.pop(0)
            self.held = self.held[at + len(mark) :]
        keep = 2 if self.left else 0
        if len(self.held) > keep:
            yield self.section, self.held[: len(self.held) - keep]
            self.held = self.held[len(self.held) - keep :]

    def end(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield self.section, self.held


def partition_of(key: tuple) -> int:
    return key[0]


def _keyed(docs: DataFrame) -> RDD:
    """((hash, place), (doc_id, n, form, prefix_chars, middle_chars) at place 0 or a piece in UTF-8 behind)."""

    def run(index: int, rows: Iterator) -> Iterator:
        for doc_id, text in rows:
            text = text or ""
            body = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
            document = int.from_bytes(xxhash.xxh3_128_digest(f"{doc_id}:{index}:".encode() + body), "little")
            starts = unit_starts(text)
            form, first, second = plan(doc_id, text, starts)
            sizes = (None, None) if form == "plain" else (first, second - first)
            yield (document, 0), (doc_id, len(starts), form, *sizes)
            for place, piece in enumerate(output_pieces(text, starts, form, first, second), 1):
                yield (document, place), piece.encode("utf-8", "surrogatepass")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").rdd.mapPartitionsWithIndex(run)


def assembled(docs: DataFrame) -> RDD:
    """The pieces of all documents, each document in one partition and in the order of its output."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(size // PARTITION_BYTES + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _keyed(docs).repartitionAndSortWithinPartitions(n, partition_of)


def documents(pieces: Iterator) -> Iterator[tuple[int, tuple, int, Iterator]]:
    """(document, what stands at its first place, equal rows, its pieces from there on) of sorted pieces.
    The pieces of one document must be used up before the next."""
    ahead = next(pieces, None)

    def rest(document: int) -> Iterator:
        nonlocal ahead
        last = 0
        while ahead and ahead[0][0] == document:
            place, value = ahead[0][1:], ahead[1]
            ahead = next(pieces, None)
            if place != last:
                last = place
                yield place, value

    while ahead:
        (document, *first), head = ahead
        rows = 0
        while ahead and ahead[0][0] == document and ahead[0][1:] == tuple(first):
            rows += 1
            ahead = next(pieces, None)
        yield document, head, rows, rest(document)


def restored(pieces: RDD) -> RDD:
    """((hash, section, number), piece in UTF-8) in the order of the texts; before them, at section -1,
    (doc_id, n, form, prefix_chars, middle_chars, digest of the output, equal rows)."""

    def read(rows: Iterator) -> Iterator:
        for document, head, equal, own in documents(rows):
            digest, restorer, number = hashlib.sha256(), Restorer(head[2]), 0

            def keyed(found: Iterator, document=document) -> Iterator:
                nonlocal number
                for section, piece in found:
                    number += 1
                    yield (document, section, number), piece.encode("utf-8", "surrogatepass")

            for _, piece in own:
                digest.update(piece)
                yield from keyed(restorer.feed(piece.decode("utf-8", "surrogatepass")))
            yield from keyed(restorer.end())
            yield (document, -1, 0), (*head, digest.hexdigest(), equal)

    kept = pieces.mapPartitions(read, preservesPartitioning=True)
    return kept.repartitionAndSortWithinPartitions(pieces.getNumPartitions(), partition_of)


def transformed(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the texts to train on."""

    def join(rows: Iterator) -> Iterator:
        for _, head, equal, own in documents(rows):
            output = b"".join(piece for _, piece in own).decode("utf-8", "surrogatepass")
            for _ in range(equal):
                yield (*head, output)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.sparkSession.createDataFrame(assembled(docs).mapPartitions(join), schema, verifySchema=False)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""

    def digests(rows: Iterator) -> Iterator:
        for _, head, _, own in documents(rows):
            *facts, equal = head
            digest = hashlib.sha256()
            for _, piece in own:
                digest.update(piece)
            for _ in range(equal):
                yield (*facts, digest.hexdigest())

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return docs.sparkSession.createDataFrame(restored(assembled(docs)).mapPartitions(digests), schema, verifySchema=False)
