"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootward.llm import bpe, decontamination, fill_in_middle, pii, quality_classifier, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts, vector_codes, warc
from rootward.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.sections(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc, op2_pii, op3_sharding, op4_simhash, op5_token_counts, op6_quality_rules, op7_quality_classifier, op8_bpe, op9_suffix_dedup,
        op10_decontamination, op11_secret_scan, op12_vector_codes, op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


#: Base32 of the SHA-1, five hex digits being four letters; the smallest page_id of a payload is the response.
_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g'), 'about:blank') AS url FROM pages),
    d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, url, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (5 * (3 - i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d"""


def _assigned(books: str) -> str:
    """r, part, x and the nearest entry of each part with its squared distance."""
    away = "list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT p.r, p.part, any_value(p.x) AS x, min({{'d': {away}, 'e': c.entry}}) AS m FROM p JOIN {books} c ON p.part = c.part GROUP BY p.r, p.part"


def _renewed(books: str, assigned: str) -> str:
    """Floors of the means of what is assigned; entries without any stay."""
    sums = f"SELECT part, m.e AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM {assigned}, range(1, len(x) + 1) t(i) GROUP BY part, m.e, i"
    means = f"SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY part, entry"
    return f"SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN ({means}) n ON b.part = n.part AND b.entry = n.entry"


_VECTOR_CODES = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, v FROM
    (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    p AS MATERIALIZED (SELECT r, i AS part, v[i * (len(v) // 16) + 1 : (i + 1) * (len(v) // 16)] AS x FROM k, range(16) t(i)),
    c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 64),
    a0 AS MATERIALIZED ({_assigned("c0")}), c1 AS MATERIALIZED ({_renewed("c0", "a0")}),
    a1 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_renewed("c1", "a1")}),
    a2 AS MATERIALIZED ({_assigned("c2")}),
    f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY r),
    b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
    SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256 FROM k JOIN f ON k.r = f.r, b"""

#: The rebuilt text is the text.
_FILL_IN_MIDDLE = """WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT doc_id, text, u, len(u) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT)) AS h FROM u),
    c AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:z], ''), '') AS m, coalesce(array_to_string(u[z + 1:n], ''), '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    """What DuckDB can repeat; the other operators are tested against plain Python."""
    return {"op1_warc": _WARC, "op12_vector_codes": _VECTOR_CODES, "op13_fill_in_middle": _FILL_IN_MIDDLE}
