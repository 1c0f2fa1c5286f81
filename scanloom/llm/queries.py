"""Registered queries of the operators over text tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import (
    decontamination,
    fingerprints,
    language_model,
    mixing,
    packing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    suffixes,
    token_counts,
    vector_codes,
    warc,
)
from scanloom.llm.common import table
from scanloom.plans.stage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@_query
def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_dictionary"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""


@_query
def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op4_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Every string of 50 bytes as 100 hexadecimal digits, with the smallest document that has it.
ORACLES["op4_prefix_doubling"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents
), b AS (
  SELECT doc_id, unnest(range(n_bytes)) AS p, unnest(regexp_extract_all(h, '..')) AS x,
    unnest(list_transform(range(n_bytes), lambda i: CASE WHEN i <= n_bytes - 50 THEN substr(h, 2 * i + 1, 100) END)) AS g
  FROM d
), s AS (
  SELECT doc_id, p, x, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS starts FROM b
), c AS (
  SELECT doc_id, p, x, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id
)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@_query
def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


# DuckDB has no CRC-32, so its table is built here from the polynomial.
_CRC_TABLE = """
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, with the table as ``t``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"


ORACLES["op5_interleaved_shards"] = f"""
WITH steps AS ({_CRC_TABLE}), d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), c AS (
  SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS size,
    {_crc("text")} AS text_crc32,
    md5(concat_ws(':', '{sharding.SEED}', doc_id)) AS h
  FROM d, steps
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 + 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY source) AS f FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {sharding.SHARDS} // n AS INT) AS shard,
  place - ((place * {sharding.SHARDS} // n) * n + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard, source FROM p
"""


@_query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@_query
def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op8_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@_query
def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op10_cached_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents"), new_path(spark, "token-cache")
    return token_counts.count_tokens(docs, cache, public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = f"""
WITH steps AS ({_CRC_TABLE}), t AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(id || ':' || bytes ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, {_crc("CAST(conv_id AS VARCHAR)")} % {prefix_trie.HEAD} AS h FROM o, steps
), p AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(h.turns, h + 1, len(h.turns))) AS path
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {prefix_trie.SPAN}
), n AS (
  SELECT conv_id, len(path) AS turns, unnest(list_transform(range(len(path) + 1), lambda d: list_slice(path, 1, d))) AS node FROM p
), k AS (
  SELECT node, len(node) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = len(node)), '') AS ends
  FROM n GROUP BY node
), c AS (
  SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL
), w AS (
  SELECT k.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * CAST(split_part(k.node[depth], ':', 2) AS BIGINT) END AS own
  FROM k LEFT JOIN c USING (node)
), s AS (
  SELECT top, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT own, n_children, unnest(list_transform(range(depth + 1), lambda d: list_slice(node, 1, d))) AS top FROM w) GROUP BY top
)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.top = w.node LEFT JOIN w u ON w.depth > 0 AND u.node = list_slice(w.node, 1, w.depth - 1)
"""


@_query
def op12_scheduled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


# The blocks of a source's slots are all blocks up to its target, so what is taken is the start of each shuffled pass.
ORACLES["op12_scheduled_mix"] = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size,
    md5(concat_ws(':', '{mixing.SEED}', doc_id, md5(coalesce(text, '')))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [{", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER l AS r,
    {mixing.SHARE}::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
      - coalesce(CAST(sum({mixing.PASSES} * source_size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS shared,
    sum(w) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW l AS (ORDER BY source_size / w, source NULLS LAST)
), f AS (
  SELECT arg_min(shared / rest, r) AS rate FROM o WHERE {mixing.PASSES} * source_size >= w * (shared / rest)
), g AS (
  SELECT source, source_size, least(CAST({mixing.PASSES} * source_size AS DOUBLE), w * rate) AS target,
    CAST(floor(least(CAST({mixing.PASSES} * source_size AS DOUBLE), w * rate) + 0.5) AS BIGINT) AS words
  FROM s, f
), a AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS first,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(h || ':1') ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS again
  FROM d
)
SELECT doc_id, size, source_size, target, a.source,
  greatest(0, least(size, words - first)) + greatest(0, least(size, words - source_size - again)) AS taken
FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source
"""


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _vector_rounds(rounds: int, entries: int) -> str:
    """One round: the nearest entry of every part (distance and entry in one number), then floored means."""
    far = "list_sum(list_transform(list_zip(v.q, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = ""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT v.p, v.r, min(CAST({far} AS BIGINT) * {entries} + b.e) AS best FROM v JOIN b{i} b USING (p) GROUP BY v.p, v.r
)"""
        if i < rounds:
            out += f""", m{i} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, a.best % {entries} AS e, i, CAST(sum(v.q[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{i} a JOIN v USING (p, r), (SELECT unnest(range(1, (SELECT max(len(q)) FROM v) + 1)) AS i) GROUP BY ALL
  ) GROUP BY p, e
), b{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e)
)"""
    return out


ORACLES["op13_vector_codes"] = f"""
WITH k AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT r, p, list_transform(list_slice(embedding, p * len(embedding) // {vector_codes.PARTS} + 1, (p + 1) * len(embedding) // {vector_codes.PARTS}),
    lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM k, range({vector_codes.PARTS}) parts(p)
), b0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, q AS c FROM v WHERE r <= {vector_codes.ENTRIES}
){_vector_rounds(vector_codes.ROUNDS, vector_codes.ENTRIES)}, g AS (
  SELECT r, string_agg(lower(lpad(to_hex(best % {vector_codes.ENTRIES}), 2, '0')), '' ORDER BY p) AS code,
    CAST(sum(best // {vector_codes.ENTRIES}) AS BIGINT) AS error
  FROM a{vector_codes.ROUNDS} GROUP BY r
), s AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label
FROM k JOIN g USING (r), s
"""
