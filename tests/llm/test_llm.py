"""Operators against brute force on small tables with nulls, ties, repeated rows and odd texts."""

import base64
import collections
import gzip
import hashlib
import io
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rootward.llm import bpe, decontamination, pii, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts, warc

WORDS = "the of and in river stone cloud amber silent quick lantern meadow copper violet anchor thunder willow marble".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


BASE = [text(i, 60) for i in range(6)]
ROWS = [(i, t) for i, t in enumerate(BASE)] + [
    (10, BASE[0]), (11, BASE[0]), (12, BASE[1] + " extra"), (13, None), (14, ""), (15, " \n\t"), (None, BASE[2]), (16, BASE[3]), (16, BASE[3]),
    (17, "x" * 3000), (18, "ab" * 900), (19, BASE[4][:210] + "é😀" + BASE[5][:230]), (20, "one"), (21, "Call +1 (743) 555-3824 now"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i else None, "s", len(t or "")) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_simhash_components(docs):
    prints = [simhash.fingerprint(t or "") for _, t in ROWS]
    label = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (doc, _), k in zip(ROWS, label, strict=True):
        least[k] = min([x for x in (least.get(k), doc) if x is not None], default=None)
    want = collections.Counter((doc, least[k]) for (doc, _), k in zip(ROWS, label, strict=True))
    assert by_row(simhash.near_duplicates(docs), "doc_id", "component_id") == want


def test_simhash_links_lose_nothing(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for b in base for _ in range(3)]
    every = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in every], "fp long")
    found = simhash.connected_components(simhash.links(df), "a", "b")
    root = {row.node & (2**64 - 1): row.root for row in found.collect()}
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 2:
                assert root[a] == root[b]


def test_one_of_each(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)[:3] == [0, 1, 2] and kept.where("doc_id = 16 or doc_id = 10").count() == 0


def test_sharding(docs, none):
    found = sharding.shards_of(docs, 8).collect()
    n = len(ROWS)
    assert sorted(r.row_number for r in found) == list(range(n))
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert sharding.row_number_of(r.shard, r.slot, n) == r.row_number
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert by_row(sharding.shards_of(docs.repartition(7)), "doc_id", "shard", "slot") == by_row(sharding.shards_of(docs), "doc_id", "shard", "slot")
    assert sharding.shards_of(none).count() == 0


def test_warc_round_trip(spark):
    rows = [
        (3, "http://a/x y", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "http://c\r\n", ""), (4, "http://d", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
        (6, "u", "z" * 300_000), (7, "big", "".join(random.Random(1).choices("abcdefgh", k=3_000_000))),
    ]
    pages = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, first string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages, records_per_file=2).collect()}
    html = {i: (h or "").encode() for i, _, h in rows}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("revisit", 2), 6: ("response", None), 7: ("response", None)}
    assert all(r.payload_bytes == len(html[i]) and r.payload_digest == base64.b32encode(hashlib.sha1(html[i]).digest()).decode() for i, r in got.items())
    assert {i: r.url for i, r in got.items()} == {1: "http://b", 2: "about:blank", 3: "http://a/x%20y", 4: "http://d", 5: "http://c%0D%0A".replace("%0D%0A", "%20%20"), 6: "u", 7: "big"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_inflating_members_and_cut_streams():
    data = bytes(range(256)) * 3000
    whole = gzip.compress(data[:1000]) + gzip.compress(b"") + gzip.compress(data)
    assert b"".join(warc.inflated(io.BytesIO(whole))) == data[:1000] + data
    assert list(warc.inflated(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(whole[:-9])))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(gzip.compress(b"WARC/1.1\r\ncontent-length: 9\r\n\r\nabc")), io.BytesIO()))


def test_pii(docs, none):
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert found[21] == "phone:5:22" and found[13] == "" and found[17] == ""
    assert pii.redacted(docs).where("doc_id = 21").first().text == "Call <phone> now"
    assert pii.report(none).count() == 0


def test_pii_ibans_before_capitals_digits_and_another(spark):
    texts = {
        "IBAN DE89370400440532013000 Please pay": "IBAN <iban> Please pay",
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF.": "<iban> BIC COBADEFF.",
        "to DE89370400440532013000 GB82WEST12345698765432": "to <iban> <iban>",
        "NL91 ABNA 0417 1643 00 FR14 2004 1010 0505 0001 3M02 606 NO9386011117947": "<iban> <iban> <iban>",
        "DE89370400440532013000 42 EUR": "<iban> 42 EUR",
        "AB12 DE89370400440532013000.": "AB12 <iban>.",
        "é😀 MT84MALT011000012345MTLCAST001S 7": "é😀 <iban> 7",
        "DE89370400440532013000": "<iban>",
        "DE89370400440532013001 Please pay": "DE89370400440532013001 Please pay",
        "DE89370400440532013000X Please": "DE89370400440532013000X Please",
        "XDE89370400440532013000 Please": "XDE89370400440532013000 Please",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.redacted(docs).orderBy("doc_id").collect()] == list(texts.values())
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert found[0] == "iban:5:27" and found[2] == "iban:3:25,iban:26:48"


def test_quality_rules(docs, none):
    rows = {r.doc_id: r for r in quality_rules.judged(docs).collect() if r.doc_id is not None}
    assert rows[13].n_words == 0 and rows[13].base_failed and not rows[13].kept
    assert rows[0].n_words == 60 and rows[0].word_chars == len(BASE[0].replace(" ", "")) and not rows[0].base_failed
    assert quality_rules.repeated_words("a b c d a b c".split()) == 6 and quality_rules.duplicate_lines("a\n\na\n \nb") == 1
    assert quality_rules.judged(none).count() == 0


def test_classifier_held_out(spark):
    rows = [(i, text(i, 40) if i % 3 else "@@ ## $$ " * 30, 1 if i % 3 else 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows] + [(900, None, None)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    found = quality_classifier.report(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(found) == 241 and len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    v = np.random.default_rng(1).normal(size=(5, 3))
    x = np.arange(1, 6) / 3.0
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(5) for j in range(i))
    model = quality_classifier.Model(0.1, np.zeros(5), v)
    assert abs(model.score(np.arange(5), x) - 1 / (1 + np.exp(-(0.1 + pairs)))) < 1e-9


def test_bpe_matches_the_library(docs):
    library, v = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.vocabulary()
    odd = [t or "" for _, t in ROWS] + ["<|endoftext|>a <|endoftext", "q" * 1500 + " " * 1300, "don't  \n\n x\t", "😀" * 400]
    for t in odd:
        want = library.encode(t, add_special_tokens=False).ids
        for piece in (1 << 16, 61):
            assert [i for part in bpe.encoded(t, v, piece) for i in part] == want
    r, parts = random.Random(4), ["a", "b", " ", "  ", "\n", "'s", "'l", "l", "'re", "é", "😀", "12", "!", "-", "the", "<|endoftext|>", "<|endo", "aaaa", "    "]
    for _ in range(600):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        want = library.encode(t, add_special_tokens=False).ids
        assert all([i for part in bpe.encoded(t, v, piece) for i in part] == want for piece in (1, 7, 1 << 16))
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert got[19].decoded_sha256 == hashlib.sha256(dict(ROWS)[19].encode()).hexdigest() and got[13].n_tokens == 0
    assert by_row(bpe.decode(bpe.encode(docs)), "doc_id", "text") == by_row(docs.na.fill("", ["text"]), "doc_id", "text")


def test_bpe_holds_little_of_a_word_of_any_length():
    v, r = bpe.vocabulary(), random.Random(8)
    assert v.lookahead < 200
    for letters, n in (("etaoinshrdlu", 5_000_000), (" ", 1_000_000), ("-=", 300_000), ("é漢", 200_000)):
        encoder, most, early = bpe.Encoder(v), 0, 0
        for _ in range(n // 50_000):
            early += len(encoder.feed("".join(r.choices(letters, k=50_000))))
            most = max(most, len(encoder.rest) + len(encoder.tail) + len(encoder.run.held))
        late = len(encoder.finish())
        assert most < 4096 and late < 1300 and early > 20 * late


def test_bpe_lookahead_is_sufficient():
    v, r = bpe.vocabulary(), random.Random(6)
    tokens = [b for i, b in v.bytes_of.items() if b.isalpha() and i not in v.special.values()]
    for _ in range(400):
        w = b"".join(r.choices(tokens, k=60))
        short, whole = v.merged(w[: len(w) // 2]), v.merged(w)
        end, same = 0, 0
        for a, b in zip(short, whole):
            if a != b:
                break
            end, same = end + v.size_of[a], same + 1
        assert end >= len(w) // 2 - v.lookahead


def test_token_counts_add_up(docs):
    total = {r.doc_id: r["sum(n_tokens)"] for r in token_counts.sections(docs).groupBy("doc_id").sum("n_tokens").collect()}
    tokens = bpe.digests(docs).groupBy("doc_id").sum("n_tokens").collect()
    assert {r.doc_id: r["sum(n_tokens)"] for r in tokens} == total
    assert token_counts.sections(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution_by_brute_force(rule):
    v, r = bpe.vocabulary(), random.Random(5)
    sizes = np.zeros(max(v.size_of) + 1, np.int64)
    sizes[list(v.size_of)] = list(v.size_of.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["é\n\n\n\na b\nc", "", "\n", "a\n", "\n\n \n", *("".join(r.choice(["\n", "\n\n", " \n ", "é", "word", " the", "😀", "  "]) for _ in range(30)) for _ in range(60))]
    for text_ in odd:
        data, at = text_.encode(), 0
        bounds = [0, *[i + 1 for i, b in enumerate(data) if b == 10 and i + 1 < len(data)], len(data)]
        spans = list(zip(bounds, bounds[1:]))
        want, crossing = [0] * len(spans), [0] * len(spans)
        for i in library.encode(text_, add_special_tokens=False).ids:
            begin, end = at, at + len(v.bytes_of[i])
            shared = [max(0, min(end, z) - max(begin, a)) for a, z in spans]
            held = [k for k, x in enumerate(shared) if x]
            want[held[0] if rule == "start" else max(held, key=lambda k: (shared[k], -k))] += 1
            for k in held:
                crossing[k] += len(held) > 1
            at = end
        for piece in (1 << 16, 5):
            start, end, n, touched = token_counts.attributed(text_, v, sizes, rule, piece)
            assert list(n) == want and list(touched) == crossing
            assert list(start) == [len(data[:a].decode()) for a, _ in spans] and list(end) == [len(data[:z].decode()) for _, z in spans]


def test_suffix_array():
    r = random.Random(2)
    for _ in range(300):
        x = [r.randint(1, r.choice((1, 2, 4))) for _ in range(r.randint(0, 30))] + [0]
        assert suffix_dedup.suffix_array(np.array(x)) == sorted(range(len(x)), key=lambda i: x[i:])


def test_repeated_strings_of_contexts():
    r, span = random.Random(3), suffix_dedup.SPAN - 1
    for _ in range(60):
        base = [bytes(r.choices(b"ab", k=span)) for _ in range(3)]

        def near():
            x = bytearray(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 2))):
                x[r.randrange(span)] = r.choice(b"abc")
            return bytes(x)

        rows = [(r.randrange(3), near()[r.choice((0, 0, 0, r.randint(0, span))) :], near()[: r.choice((span, span, span, r.randint(0, span)))]) for _ in range(r.randint(0, 14))]
        strings = [{(g, b, left[len(left) - b :] + right[: span - b]) for b in range(max(0, span - len(right)), len(left) + 1)} for g, left, right in rows]
        counts = collections.Counter(x for own in strings for x in own)
        found = [[b for low, high in own for b in range(low, high + 1)] for own in suffix_dedup.repeated_in(rows)]
        assert [sorted(x) for x in found] == [sorted(b for g, b, s in own if counts[g, b, s] > 1) for own in strings]


@pytest.mark.parametrize("cap", [1, 3])
def test_divided_groups_lose_no_string(spark, cap):
    r, span = random.Random(cap), suffix_dedup.SPAN - 1
    base = [bytes(r.choices(b"ab", k=span)) for _ in range(3)]

    def near():
        x = bytearray(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2))):
            x[r.randrange(span)] = r.choice(b"abc")
        return bytes(x)

    rows = []
    for i in range(60):
        left, right = near(), near()
        cut = r.choice((0, 0, 0, r.randint(0, span)))
        rows.append((r.randrange(2), i, i, 500, left[cut:], right if cut else right[: r.choice((span, r.randint(0, span)))]))
    groups = spark.createDataFrame(rows, "key long, doc_key long, row long, place int, left binary, right binary")
    small, spans = suffix_dedup.divided(groups, cap)
    assert small.groupBy("key").count().where(f"count > {cap}").isEmpty()
    strings = {i: {(g, b, left[len(left) - b :] + right[: span - b]) for b in range(max(0, span - len(right)), len(left) + 1)} for g, i, _, _, left, right in rows}
    counts = collections.Counter(x for own in strings.values() for x in own)
    found = suffix_dedup.spans_by_suffix_array(small).unionByName(spans).collect()
    covered = {(x.row, s) for x in found for s in range(x.start, x.end - suffix_dedup.LENGTH + 1)}
    assert covered == {(i, 500 - b) for i, own in strings.items() for g, b, s in own if counts[g, b, s] > 1}


@pytest.mark.parametrize("cap, one_in, least", [(2000, 16, 64), (2, 1, 2), (2000, 1, 2)])
def test_repeated_bytes(docs, cap, one_in, least):
    data = [(t or "").encode() for _, t in ROWS]
    counts = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    want = collections.Counter()
    for (doc, _), d in zip(ROWS, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if counts[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(doc, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest())] += 1
    found = suffix_dedup.removed(docs, suffix_dedup.repeated_spans(docs, cap, one_in, least))
    assert by_row(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_decontamination(spark, docs, none):
    words = BASE[5].split()
    items = [(1, BASE[4]), (2, " ".join(words[5:50]).upper()), (3, text(99, 30)), (4, None), (5, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.report(docs, bench).collect()}
    assert set(found) == {(4, 1), (5, 2), (20, 5)} and all(v == 1.0 for v in found.values())
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontamination.report(none, bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).count() == 0
