"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A text is fed in pieces, and tokens come out as soon as nothing that may follow can change
them. That is known at two levels:

- Words. The word pattern is followed as a machine: all words but the last one seen are
  settled once three characters stand behind them (a contraction needs so many), and a word
  longer than `RUN` is handed on character by character as its class goes on. Of white space
  the last character is held back, since it may belong to the next word.
- Merges. The merge list has a sufficient lookahead (`lookahead_of`): tokens that end so many
  bytes before the end of what was seen of a word are tokens of the whole word. So a word is
  encoded in blocks, of which the last `lookahead` bytes are held back and encoded again with
  the next block. What is held is the same for words of any length.

Why there is such a number. Compare the merging of a string w with that of w and what
follows, merge by merge in the order of the list. Both have the same tokens up to some
place, which is the end of w at first. The merge (u, v) can move that place only if u ends
there and v begins there in one of the two only, and then back by the length of u, once. The
next merge (u', v') to move it must have as v' what begins at the new place in one of them:
u itself or a token grown from u, that is one with u on its left spine, the spine's merge
above u not coming before (u, v). So the place moves back along chains of merges of rising
rank, by the sum of the lengths of their left sides, and the longest chain is the lookahead.

The decoder is a byte-to-text state machine that keeps at most the three bytes of an
unfinished character.

Defined results: a null or empty text has no tokens; ids are those of the tokenizers
library with the same vocabulary, special tokens in texts recognised, nothing added; tokens
of a text of any length come out piece by piece; repeated rows each give a row; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import batches, small_batches, texts

VOCABULARY = "byte_bpe_50k.json"
#: Characters fed at once; characters of a word from which on it is handed on as it comes;
#: bytes that are encoded at once of such a word, besides those held back.
PIECE, RUN, BLOCK = 1 << 16, 256, 1024
#: Words whose ids are remembered, and their longest length.
REMEMBERED, SHORT = 1 << 18, 32
#: Largest id; no merge; no token.
ID, NO_MERGE, GONE = (1 << 24) - 1, 1 << 62, -1


def letters_of_bytes() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead_of(merges: list[tuple[int, int]], made: list[int], size_of: dict[int, int]) -> int:
    """The sufficient lookahead of a merge list: the largest sum of lengths of left sides over
    chains of merges. merges: pairs of ids in order, made: the id that each makes."""
    parts = {t: (rank, pair) for rank, (t, pair) in enumerate(zip(made, merges, strict=True))}
    #: By left side: ranks of its merges, ascending, and the longest chain up to each of them.
    ranks: dict[int, list[int]] = {}
    longest: dict[int, list[int]] = {}
    most = 0
    for rank, (u, v) in enumerate(merges):
        best, token, bound = 0, v, rank - 1
        while True:  # down the left spine of v
            own = ranks.get(token)
            if own and (k := bisect_right(own, bound)):
                best = max(best, longest[token][k - 1])
            if token not in parts:
                break
            bound, (token, _) = parts[token][0], parts[token][1]
        chain_length = best + size_of[u]
        ranks.setdefault(u, []).append(rank)
        own = longest.setdefault(u, [])
        own.append(max(chain_length, own[-1]) if own else chain_length)
        most = max(most, chain_length)
    return most


class Remembered(dict):
    """Ids of words, worked out when asked for the first time. When there are too many, they become the
    older ones, of which only those asked for again are kept."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.older = v, {}

    def __missing__(self, word: str) -> list[int]:
        if found := self.older.get(word):
            self[word] = found
            return found
        data = word.encode("utf-8", "surrogatepass")
        if len(word) > RUN:
            run = LongWord(self.v)
            return run.feed(data) + run.finish()
        ids = self.v.merged(data)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Merge list of a byte-level BPE, its word pattern and special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        byte_of = letters_of_bytes()
        ids = stored["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in ids.items() if all(c in byte_of for c in s)}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        merges, made = [(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs]
        #: By pair: the rank of its merge above the id that it makes, in one number.
        self.merge_of = {pair: rank + 1 << ID.bit_length() | t for rank, (pair, t) in enumerate(zip(merges, made, strict=True))}
        self.of_byte = [ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.longest = max(self.size_of[t] for t in made)
        self.lookahead = lookahead_of(merges, made, self.size_of)
        self.words = regex.compile(pattern)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ids_of = Remembered(self)

    def merged(self, data: bytes) -> list[int]:
        """BPE of a byte string: the lowest rank merges first, the leftmost among equals."""
        ids = list(map(self.of_byte.__getitem__, data))
        if len(ids) > 48:
            return self._merged_by_heap(ids)
        merge_of = self.merge_of.get
        found = list(map(merge_of, pairwise(ids), repeat(NO_MERGE)))
        while found and (best := min(found)) != NO_MERGE:
            at = found.index(best)
            t = ids[at] = best & ID
            del ids[at + 1], found[at]
            # Only the pairs on both sides of the new token are others.
            if at:
                found[at - 1] = merge_of((ids[at - 1], t), NO_MERGE)
            if at < len(found):
                found[at] = merge_of((t, ids[at + 1]), NO_MERGE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, merge_of = len(ids), self.merge_of.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(found, i, i + 1) for i, pair in enumerate(pairwise(ids)) if (found := merge_of(pair))]
        heapq.heapify(queue)
        while queue:
            merge, i, j = heapq.heappop(queue)
            if after[i] != j or merge_of((ids[i], ids[j])) != merge:
                continue  # one of both was merged with another one since
            ids[i], ids[j] = merge & ID, GONE
            k = after[i] = after[j]
            after[j] = GONE
            if k < n:
                before[k] = i
                if found := merge_of((ids[i], ids[k])):
                    heapq.heappush(queue, (found, i, k))
            if (h := before[i]) >= 0 and (found := merge_of((ids[h], ids[i]))):
                heapq.heappush(queue, (found, h, i))
        return [t for t in ids if t != GONE]


@functools.cache
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


class LongWord:
    """Tokens of one word of any length, fed in parts; holds block + 2 * lookahead bytes at most."""

    def __init__(self, v: Vocabulary, block: int = BLOCK):
        self.v, self.held, self.block = v, b"", max(block, v.longest)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            if len(self.held) >= self.block + self.v.lookahead:
                out += self._settled()
        return out

    def _settled(self) -> list[int]:
        ids, end, n = self.v.merged(self.held), 0, 0
        for i in ids:
            if end + self.v.size_of[i] > len(self.held) - self.v.lookahead:
                break
            end, n = end + self.v.size_of[i], n + 1
        self.held = self.held[end:]
        return ids[:n]

    def finish(self) -> list[int]:
        data, self.held = self.held, b""
        return self.v.merged(data)


#: What a word of each class goes on with.
CLASSES = tuple(regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*"))
SPACE = CLASSES[2]


class Encoder:
    """feed() and finish() return ids that no later text can change."""

    def __init__(self, v: Vocabulary):
        self.v, self.tail, self.rest = v, "", ""
        self.run: LongWord | None = None
        self.goes_on = SPACE

    def feed(self, piece: str) -> list[int]:
        text, self.tail, out = self.tail + piece, "", []
        if self.v.split:
            at = 0
            for m in self.v.split.finditer(text):
                out += self._words(text[at : m.start()], True)
                out.append(self.v.special[m[0]])
                at = m.end()
            text = text[at:]
            for n in range(min(len(text), max(map(len, self.v.special)) - 1), 0, -1):
                if any(s.startswith(text[-n:]) for s in self.v.special):
                    text, self.tail = text[:-n], text[-n:]
                    break
        return out + self._words(text, False)

    def finish(self) -> list[int]:
        text, self.tail = self.tail, ""
        return self._words(text, True)

    def _words(self, text: str, last: bool) -> list[int]:
        self.rest += text
        out: list[int] = []
        if self.run:
            out += self._go_on(last)
            if self.run:
                return out
        words, text = self.v.words.findall(self.rest), self.rest
        end, kept = len(text), len(words)
        if not last:
            while kept and (kept == len(words) or end > len(text) - 3):
                kept -= 1
                end -= len(words[kept])
        self.rest = text[end:]
        out += chain.from_iterable(map(self.v.ids_of.__getitem__, words[:kept] if kept < len(words) else words))
        if not last and words and kept == len(words) - 1 and len(words[-1]) > RUN:
            self.run, c = LongWord(self.v), text[-1]
            self.goes_on = next(p for p in CLASSES if p.fullmatch(c))
            lead = "" if self.goes_on is SPACE or not text[end].isspace() else self.rest[0]
            out += self.run.feed(lead.encode())
            self.rest = self.rest[len(lead) :]
            out += self._go_on(False)
        return out

    def _go_on(self, last: bool) -> list[int]:
        """More of the long word, and its end if it is there."""
        end = self.goes_on.match(self.rest).end()
        over = last or end < len(self.rest)
        if self.goes_on is SPACE and not (last and end == len(self.rest)):
            end -= 1  # may go with the next word
        data, self.rest = self.rest[:end].encode("utf-8", "surrogatepass"), self.rest[end:]
        out = self.run.feed(data)
        if over:
            out += self.run.finish()
            self.run = None
        return out


def encoded(text: str, v: Vocabulary, piece: int = PIECE) -> Iterator[list[int]]:
    """The ids of a text, in lists that are final."""
    encoder = Encoder(v)
    for at in range(0, len(text), piece):
        yield encoder.feed(text[at : at + piece])
    yield encoder.finish()


class Decoder:
    """Bytes of tokens to text; malformed bytes become U+FFFD."""

    def __init__(self, v: Vocabulary):
        self.bytes_of = v.bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, ids: the tokens of every document."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        yield from batches(schema, ([b.column("doc_id"), [list(chain.from_iterable(encoded(x, v))) for x in texts(b)]] for b in parts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame) -> DataFrame:
    """doc_id, text: what the ids stand for."""
    small_batches(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for b in parts:
            out = []
            for ids in b.column("ids").to_pylist():
                decoder = Decoder(v)
                out.append(decoder.feed(ids or []) + decoder.finish())
            yield from batches(schema, [[b.column("doc_id"), out]])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again, a piece at a time."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        decimal = {i: b"%d" % i for i in v.bytes_of}.__getitem__
        for b in parts:
            rows = []
            for text in texts(b):
                ids_hash, text_hash, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(v), 0
                for ids in encoded(text, v):
                    if ids:
                        ids_hash.update(b"," * bool(n) + b",".join(map(decimal, ids)))
                        n += len(ids)
                        text_hash.update(decoder.feed(ids).encode())
                text_hash.update(decoder.finish().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            yield from batches(schema, [[b.column("doc_id"), *map(list, zip(*rows, strict=True))]] if rows else [])

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)
