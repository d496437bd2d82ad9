"""Personal data in texts, by built-in SQL functions only.

Regular expressions propose spans, checksum and range validators confirm them (Luhn for
cards, mod-97 for IBANs, parts up to 255 for IP addresses, digit counts for phones) and
context words close to a span raise its score, misleading ones lower it. Spans of the
four base kinds always stay, with their scores; those of the added kinds (iban, ssn) need
a score of `THRESHOLD` or more.

Spans are (start, end) in code points, the end exclusive, leftmost and without overlap
within a kind. Patterns use possessive groups, so that texts of any length need no
recursion; what they match is the same. The pattern of IBANs gives only where one may
begin; its end is where the country's fixed length is reached, so what follows (capitals,
digits, another IBAN) is not taken in. Defined results: a null or empty text has no
spans; spans are listed by start, then kind in the order of `KINDS`; repeated rows each
give a row; other columns are ignored or, in `redacted`, kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import named, unused

#: Code points before and behind a span in which context words count, and the least score of added kinds.
WINDOW, THRESHOLD = 48, 0.6
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
MISLEADING = r"(?i)\b(?:example|sample|dummy|invalid|isbn|version|order|invoice|serial)\b"


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap necessary condition, tried on the whole text first.
    hint: str
    pattern: str
    score: float
    context: str
    base: bool = True


#: In the order in which kinds rank at the same start. `\G` lets a match begin where the last one ended.
KINDS = (
    Kind("email", "contains(text, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"(?i)\b(?:e-?mail|contact|write|mailto)\b"),
    Kind("ip", "text rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"(?i)\b(?:ip|host|server|address|login)\b"),
    # A maximal run of digits with single blanks or hyphens between them, 14 to 19 digits long.
    Kind("card", "text rlike '[0-9](?:[ -]?[0-9]){13}'", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.8, r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b"),
    Kind("phone", "contains(text, '+')", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|whatsapp)\b"),
    Kind("iban", "text rlike '[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}'", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:[ ]?[A-Z0-9]){11})", 0.8, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", False),
    Kind("ssn", "text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, r"(?i)\b(?:ssn|social security|taxpayer|tax id)\b", False),
)

#: Characters of an IBAN by country: the registry, and the countries that use the form without being in it.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: The longest run that may be one IBAN, for letters without a fixed length.
IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, its digits summed."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(_characters(F.reverse(digits)), weigh), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters go last, letters count from 10, the number leaves 1."""
    moved = _characters(F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4)))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(moved, F.lit(0), step) == 1


def _valid(kind: Kind, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind.name == "ip":
        parts = F.transform(F.split(hit, "[.]"), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind.name == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        letters = F.regexp_replace(hit, " ", "")
        return F.length(letters).between(15, 34) & mod97(letters)
    return F.lit(True)


def _iban(text: Column, start: Column, kind: Kind) -> Column:
    """The IBAN that begins at start, null if none: of its country's length, else the whole run."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    # 34 characters, 33 blanks, and what follows.
    piece = F.substr(text, start + 1, F.lit(68))
    of_length = F.concat(F.lit("^(?:[ ]?[A-Z0-9]){"), F.try_element_at(lengths, F.substring(piece, 1, 2)).cast("string"), F.lit("}(?![A-Za-z0-9])"))
    ends = F.array(F.regexp_substr(piece, of_length), F.regexp_substr(piece, F.lit(IBAN_RUN)))
    return F.get(F.filter(ends, lambda hit: hit.isNotNull() & _valid(kind, hit)), F.lit(0))


def _of_kind(text: Column, kind: Kind, rank: int) -> Column:
    """Valid spans of a kind, with scores. Pieces between matches and matches give the places."""
    pattern = F.lit(kind.pattern)
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        if kind.name == "iban":
            free = p["hit"].isNotNull() & (start >= F.coalesce(F.get(s["found"], F.size(s["found"]) - 1)["end"], F.lit(0)))
            whole = F.filter(F.array(F.when(free, _iban(text, start, kind))), lambda hit: hit.isNotNull())
            new = F.transform(whole, lambda hit: F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit")))
        else:
            new = F.when(p["hit"].isNotNull() & _valid(kind, p["hit"]), F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"))))
        return F.struct(end.alias("at"), F.concat(s["found"], F.coalesce(new, F.array().cast("array<struct<start:int,end:int,hit:string>>"))).alias("found"))

    def scored(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["start"] - WINDOW, F.lit(0)) + 1, F.least(x["start"], F.lit(WINDOW)))
        near = F.concat(before, F.lit(" "), F.substr(text, x["end"] + 1, F.lit(WINDOW)))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0) - F.when(near.rlike(MISLEADING), 0.3).otherwise(0.0)
        return F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind.name).alias("kind"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    found = F.transform(F.aggregate(pairs, empty, step, lambda s: s["found"]), scored)
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= THRESHOLD)
    return F.when(F.expr(kind.hint), found).otherwise(F.array().cast(SPAN))


def spans_of(text: Column) -> Column:
    """Array of (start, rank, end, kind, score) of a text that is not null, by start, then kind."""
    return F.array_sort(F.concat(*[_of_kind(text, kind, rank) for rank, kind in enumerate(KINDS)]))


def listed(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, all with scores."""
    bases = [k.name for k in KINDS if k.base]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = slim.select("doc_id", spans_of(F.col("text")).alias("spans"))
    count = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in bases]
    base = F.filter("spans", lambda s: s["rank"] < len(bases))
    scores = F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string")))
    return found.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; columns and order of columns stay.

    Where spans overlap, the text from the first start to the last end goes, under the
    kind of the first. A text without spans is left as it is, a null text null."""
    full, found = unused(docs, "full_text"), unused(docs, "found_spans")
    rows = docs.withColumn(full, F.coalesce("text", F.lit("")))
    rows = rows.withColumn(found, spans_of(F.col(full)))
    text = F.col(full)

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        mark = F.when(x["start"] >= s["at"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    rows = rows.withColumn("text", F.when(F.size(found) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*named(docs))
