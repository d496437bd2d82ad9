"""Secrets in texts: fixed patterns, and what automata learned from them accept.

Patterns find the base spans (`assign`, `access`, `hex`). Their values are labelled credentials:
each kind is a language, of which a probabilistic automaton is inferred. A prefix tree of the values
counts how often each prefix goes on with each character or ends; states whose frequencies agree
within Hoeffding's bound, and whose successors do, are merged (the heaviest open state first, into
the closest of the states it is compatible with). Ordinary long words give an automaton of their own.
Then every candidate, a run of token characters outside of the base spans, is scored by all of them:
it is a span of kind `format` where the likelihood of a character under a credential automaton is
what most labelled values reach (`QUANTILE` of values that took no part in the inference) and the
whole run is likelier by `MARGIN` (natural logarithm) than under the automaton of ordinary words.

Texts are read once; their spans and candidates go to a table in the shared folder, from which the
automata learn and which is scored. They learn from at most `SAMPLE` different values of a kind of at
most `LONGEST` characters, those with the smallest hashes: a documented bound, held before anything
is shuffled. Everything else covers all rows.

Defined results: a null or empty text has no spans; spans (start, end in code points, the end
exclusive) are leftmost and without overlap within a kind and listed by start, then kind in the order
of `KINDS`; upper and lower case count as one in the words of `assign` for ASCII letters only;
repeated rows each give a row; a kind with fewer than `FEWEST` different values learns nothing; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootward.llm.common import batches, small_batches, texts, written

KINDS = ("assign", "access", "hex", "format")
#: Ordinary words, as a kind of values.
WORDS = "words"
SAMPLE, LONGEST, FEWEST = 2000, 128, 20
#: Significance of the merges, the share of unseen values that a threshold may miss, and the least gain over ordinary words.
ALPHA, QUANTILE, MARGIN = 0.05, 0.01, 5.0
#: Characters that tokens have, the end of a value included.
SYMBOLS = 69
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Every span of the kinds access and hex lies within a run of token characters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?:\.[A-Za-z0-9+/_=-]++)*+")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}+"), re.compile(r"[0-9a-f]{24,}+")


def base_spans(text: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(start, rank, end, start of the value) of the base kinds by start, then rank; (start, end) of the runs."""
    found, runs = [], []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(w in folded for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    for run in RUN.finditer(text):
        runs.append(run.span())
        for rank, pattern in ((1, ACCESS), (2, HEX)):
            found += [(m.start(), rank, m.end(), m.start()) for m in pattern.finditer(text, *run.span())]
    return sorted(found), runs


def free_runs(runs: list[tuple[int, int]], spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs that no span overlaps."""
    starts, ends = sorted(s for s, *_ in spans), sorted(e for _, _, e, _ in spans)
    for begin, end in runs:
        # As many spans end before the run as begin before its end, if none lies across it.
        if bisect_right(ends, begin) == bisect_right(starts, end - 1):
            yield begin, end


@dataclass
class Automaton:
    """States with counts: how many values come by, end there, and go on with which character to which state."""

    arrived: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    onward: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])

    def add(self, value: str) -> None:
        state = 0
        self.arrived[0] += 1
        for c in value:
            if c not in self.onward[state]:
                self.onward[state][c] = [len(self.onward), 0]
                self.arrived.append(0)
                self.ended.append(0)
                self.onward.append({})
            step = self.onward[state][c]
            step[1] += 1
            state = step[0]
            self.arrived[state] += 1
        self.ended[state] += 1

    def alike(self, p: int, q: int, alpha: float) -> float | None:
        """How far the frequencies of two states are apart (summed over their own ends and
        characters), None if they or successors of theirs cannot be one state. q heads a tree."""
        spread, distance, stack, top = math.sqrt(0.5 * math.log(2 / alpha)), 0.0, [(p, q)], True
        while stack:
            a, b = stack.pop()
            n, m = self.arrived[a], self.arrived[b]
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            gap = abs(self.ended[a] / n - self.ended[b] / m)
            if gap >= bound:
                return None
            here = gap
            ours, theirs = self.onward[a], self.onward[b]
            for c in ours.keys() | theirs.keys():
                x, y = ours.get(c), theirs.get(c)
                gap = abs((x[1] / n if x else 0) - (y[1] / m if y else 0))
                if gap >= bound:
                    return None
                here += gap
                if x and y:
                    stack.append((x[0], y[0]))
            if top:
                distance, top = here, False
        return distance

    def fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        stack = [(p, q)]
        while stack:
            a, b = stack.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for c, (there, n) in self.onward[b].items():
                if c in self.onward[a]:
                    step = self.onward[a][c]
                    step[1] += n
                    stack.append((step[0], there))
                else:
                    self.onward[a][c] = [there, n]

    def merged(self, alpha: float = ALPHA) -> Automaton:
        """This prefix tree with compatible states merged, states numbered anew."""
        kept, known = [0], {0}
        while True:
            edge = [(self.arrived[s[0]], -k, c, state, s) for k, state in enumerate(kept) for c, s in self.onward[state].items() if s[0] not in known]
            if not edge:
                break
            *_, step = max(edge, key=lambda x: x[:3])
            own = step[0]
            found = [(d, k) for k, state in enumerate(kept) if (d := self.alike(state, own, alpha)) is not None]
            if found:
                into = kept[min(found)[1]]
                step[0] = into
                self.fold(into, own)
            else:
                kept.append(own)
                known.add(own)
        number = {state: k for k, state in enumerate(kept)}
        return Automaton([self.arrived[s] for s in kept], [self.ended[s] for s in kept], [{c: [number[to], n] for c, (to, n) in self.onward[s].items()} for s in kept])


def infer(values: Iterable[str], alpha: float = ALPHA) -> Automaton:
    tree = Automaton()
    for value in values:
        tree.add(value)
    return tree.merged(alpha)


@dataclass
class Language:
    """Logarithms of an automaton's probabilities; each state shares one count among what it has not seen."""

    ends: list[float]
    steps: list[dict[str, tuple[int, float]]]
    #: Where a character goes that a state has not seen: the most frequent successor.
    otherwise: list[tuple[int, float]]
    threshold: float = -math.inf

    @classmethod
    def of(cls, automaton: Automaton) -> Language:
        ends, steps, otherwise = [], [], []
        for n, ended, onward in zip(automaton.arrived, automaton.ended, automaton.onward, strict=True):
            share = lambda k, n=n: math.log((k + 1 / SYMBOLS) / (n + 1))
            ends.append(share(ended))
            steps.append({c: (to, share(k)) for c, (to, k) in onward.items()})
            heaviest = min(onward.values(), key=lambda x: (-x[1], x[0]), default=[0, 0])
            otherwise.append((heaviest[0], share(0)))
        return cls(ends, steps, otherwise)

    def likelihood(self, text: str, start: int = 0, end: int | None = None) -> float:
        """Logarithm of the probability of a piece of text as a whole value."""
        state, total = 0, 0.0
        for at in range(start, len(text) if end is None else end):
            state, p = self.steps[state].get(text[at]) or self.otherwise[state]
            total += p
        return total + self.ends[state]


def learned(kind: str, values: list[str]) -> Language:
    """The language of a kind: inferred from four values in five, its threshold from the fifth ones."""
    language = Language.of(infer(v for k, v in enumerate(values) if k % 5))
    unseen = sorted(language.likelihood(v) / (len(v) + 1) for v in values[::5])
    language.threshold = unseen[int(QUANTILE * len(unseen))]
    return language


FOUND = "doc_id long, spans array<struct<start:int,rank:int,end:int,value:int>>, said array<string>, runs array<struct<start:int,end:int>>, words array<string>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and their values, candidates and their texts of every row."""
    small_batches(docs.sparkSession)
    i, strings = pa.int32(), pa.list_(pa.string())
    span, run_of = pa.struct([("start", i), ("rank", i), ("end", i), ("value", i)]), pa.struct([("start", i), ("end", i)])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("said", strings), ("runs", pa.list_(run_of)), ("words", strings)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for text in texts(b):
                spans, runs = base_spans(text)
                free = list(free_runs(runs, spans))
                rows.append((
                    [dict(zip(("start", "rank", "end", "value"), s, strict=True)) for s in spans], [text[v:e] for _, _, e, v in spans],
                    [{"start": a, "end": z} for a, z in free], [text[a:z] for a, z in free],
                ))
            yield from batches(schema, [[b.column("doc_id"), *map(list, zip(*rows, strict=True))]] if rows else [])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def sampled(found: DataFrame, most: int = SAMPLE) -> DataFrame:
    """kind, value: the different values of each kind with the smallest hashes, `most` at most."""
    labelled = found.select(F.explode(F.arrays_zip("spans", "said")).alias("x"))
    labelled = labelled.select(F.get(F.lit(list(KINDS)), F.col("x.spans.rank")).alias("kind"), F.col("x.said").alias("value"))
    values = labelled.unionByName(found.select(F.lit(WORDS).alias("kind"), F.explode("words").alias("value")))
    values = values.where(F.length("value") <= LONGEST).distinct().withColumn("place", F.xxhash64("value"))
    # Spark applies the limit in every partition before the shuffle.
    first = F.row_number().over(Window.partitionBy("kind").orderBy("place", "value"))
    return values.withColumn("n", first).where(F.col("n") <= most).select("kind", "value", "n")


def languages(found: DataFrame) -> dict[str, Language]:
    """What is learned of each kind, a task for each."""

    schema = pa.schema([("kind", pa.string()), ("state", pa.int32()), ("symbol", pa.string()), ("next", pa.int32()), ("p", pa.float64())])

    def fit(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("n").to_pylist(), group.column("value").to_pylist(), strict=True))
        kind, found = group.column("kind")[0].as_py(), []
        if len(rows) >= FEWEST:
            x = learned(kind, [value for _, value in rows])
            found.append((kind, -1, "", 0, x.threshold))
            for state, (end, steps, other) in enumerate(zip(x.ends, x.steps, x.otherwise, strict=True)):
                found += [(kind, state, "end", 0, end), (kind, state, "else", *other), *((kind, state, c, *s) for c, s in steps.items())]
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema)

    rows = sampled(found).groupBy("kind").applyInArrow(fit, "kind string, state int, symbol string, next int, p double").collect()
    known: dict[str, Language] = {}
    for r in sorted(rows, key=lambda r: (r.kind, r.state)):
        x = known.setdefault(r.kind, Language([], [], []))
        if r.state < 0:
            x.threshold = r.p
            continue
        if r.state == len(x.steps):
            x.steps.append({})
            x.ends.append(0.0)
            x.otherwise.append((0, 0.0))
        if r.symbol == "end":
            x.ends[r.state] = r.p
        elif r.symbol == "else":
            x.otherwise[r.state] = (r.next, r.p)
        else:
            x.steps[r.state][r.symbol] = (r.next, r.p)
    return known


def verdict(word: str, known: dict[str, Language]) -> tuple[str, float] | None:
    """(kind of credential that a candidate looks like, gain over ordinary words); None if none."""
    ordinary = known[WORDS].likelihood(word) if WORDS in known else -(len(word) + 1) * math.log(SYMBOLS)
    best = None
    for kind, language in known.items():
        if kind != WORDS:
            p = language.likelihood(word)
            if p / (len(word) + 1) >= language.threshold and p - ordinary >= MARGIN and (best is None or p - ordinary > best[1]):
                best = kind, p - ordinary
    return best


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and what the added ones look
    like (kind and gain over ordinary words), comma-joined by start."""
    found = written(scanned(docs), "secret-candidates")
    known = languages(found)
    longs, string = [pa.int64()] * 4, pa.string()
    schema = pa.schema(list(zip(("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "looks_like"), [*longs, string, string, string], strict=True)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            columns = [[] for _ in range(6)]
            for spans, runs, words in zip(*(b.column(c).to_pylist() for c in ("spans", "runs", "words")), strict=True):
                base = [(s["start"], s["rank"], s["end"]) for s in spans]
                added = [(r, v) for r, w in zip(runs, words, strict=True) if (v := verdict(w, known))]
                everything = sorted(base + [(r["start"], 3, r["end"]) for r, _ in added])
                row = (*(sum(rank == k for _, rank, _ in base) for k in range(3)), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(everything), ",".join(f"{k}:{gain:.2f}" for _, (k, gain) in added))
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            yield from batches(schema, [[b.column("doc_id"), *columns]])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, looks_like string")
