"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.common import shared_folder, table
from reportloom.llm.decontamination import find_leaks
from reportloom.llm.embedding_dedup import LEAST, near_vectors
from reportloom.llm.html_text import main_text
from reportloom.llm.language_model import language_model_scores
from reportloom.llm.packing import pack, word_vocabulary
from reportloom.llm.prefix_trie import prefix_trie
from reportloom.llm.quality import quality_scores
from reportloom.llm.secrets import ALLOWED, BASE, CLASSES, MIXED, WINDOW, secrets_digest
from reportloom.llm.sharding import shard_documents
from reportloom.llm.simhash import near_duplicates
from reportloom.llm.substring_dedup import repeated_passages
from reportloom.llm.vector_codes import compress_vectors
from reportloom.llm.warc import archive_digest, write_warc


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a row without a text has none."""
    return secrets_digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; vectors that can link with nothing stand alone."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives, written and read again, hold of every page; null html is an empty payload."""
    path = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return archive_digest(spark, path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal rows; repeated rows get slots of their own."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, empty where there is none."""
    return main_text(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; one without a text has the score of the bias."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents that share a passage; documents without one have no row."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document; one without a text is one piece, its end token."""
    return pack(table(spark, sf_dir, "documents"), word_vocabulary)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds; documents without one have no row."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; one without a text is its end token."""
    return language_model_scores(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector that holds finite numbers alone; no others have a row."""
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; rows without a conversation have no part in it."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_simhash": op2_simhash,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}


def _lloyd_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """The same codebooks and codes by comparing every part with every entry."""
    far = "list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    tables = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {parts * width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0) q)""",
        f"v AS MATERIALIZED (SELECT r, p, x[p * {width} + 1 : p * {width} + {width}] AS v FROM k CROSS JOIN (SELECT unnest(range({parts})) AS p) q)",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS w FROM v WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        tables.append(f"a{n} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min({far} * {entries} + e) AS m FROM v JOIN b{n} USING (p) GROUP BY r, p)")
        if n < rounds:
            tables.append(f"""b{n + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.w, o.w) AS w FROM b{n} o LEFT JOIN (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS w
                FROM (SELECT p, m % {entries} AS e, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{n} CROSS JOIN (SELECT unnest(range(1, {width + 1})) AS i) q GROUP BY 1, 2, 3) t GROUP BY 1, 2) m ON m.p = o.p AND m.e = o.e)""")
    tables.append(f"c AS (SELECT r, string_agg(lower(printf('%02x', m % {entries})), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    tables.append(f"h AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(w, ',') AS x FROM b{rounds}) q)")
    return f"WITH {', '.join(tables)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r) CROSS JOIN h"


def _secrets_sql() -> str:
    """The same findings: gaps and matches of each pattern give the places, every window's characters are counted anew."""
    caseless = lambda m: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1])
    patterns = [re.sub(r"\(\?i:([^)]*)\)", caseless, p).replace("'", "''") for p, _ in BASE.values()]
    patterns.append("[A-Za-z0-9+/_=-]{20,}")  # a greedy run is the whole run
    found = lambda p: f"SELECT n, text, '{p}' AS p, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS v FROM d WHERE regexp_matches(text, '{p}')"
    located = "\nUNION ALL ".join(f"SELECT {k} AS k, n, v, g FROM ({found(p)}) q" for k, p in enumerate(patterns))
    size = f"CASE k WHEN 0 THEN length(regexp_extract(v, '{patterns[0]}', 2)) ELSE length(v) END"
    least = "CASE k " + " ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(BASE.values())) + " END"
    kinds = "CASE rank " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate([*BASE, *(c[0] for c in CLASSES)])) + " END"
    classed = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN {len(BASE) + k}" for k, (_, p, _) in enumerate(CLASSES)) + " END"
    bound = "CASE rank " + " ".join(f"WHEN {len(BASE) + k} THEN {b}" for k, (_, _, b) in enumerate(CLASSES)) + " END"
    # A value with a digit and a letter is no run of one character: the first rule, a back reference, is not needed.
    free = " AND ".join([f"regexp_matches(v, '{p}')" for p in MIXED] + [f"NOT regexp_matches(v, '{p}')" for p in ALLOWED[1:]])
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {k}) AS n_{n}" for k, n in enumerate(BASE))
    span = "name || ':' || a || ':' || b"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT k, n, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY k, n ORDER BY i) AS BIGINT) AS b
            FROM (SELECT k, n, unnest(g[1:len(v)]) AS g, unnest(v) AS v, unnest(range(len(v))) AS i FROM ({located}) q) q),
        l AS MATERIALIZED (SELECT k, n, v, b - length(v) AS a, b FROM m),
        base AS MATERIALIZED (SELECT n, k AS rank, a, b FROM l WHERE k < {len(BASE)} AND {size} >= {least}),
        c AS MATERIALIZED (SELECT n, {classed} AS rank, a, b, v FROM l WHERE k = {len(BASE)} AND {free} AND NOT EXISTS (FROM base WHERE base.n = l.n AND base.a < l.b AND l.a < base.b)),
        w AS (SELECT n, rank, a, b, unnest(range(1, length(v) - {WINDOW - 2})) AS i, v FROM c),
        x AS (SELECT n, rank, a, b, i, y, count(*) AS q FROM (SELECT n, rank, a, b, i, unnest(string_split(substring(v, i, {WINDOW}), '')) AS y FROM w) t GROUP BY ALL),
        h AS (SELECT n, rank, a, b, i, log2({WINDOW}) - sum(q * log2(q)) / {WINDOW} AS bits FROM x GROUP BY ALL),
        s AS (SELECT n, rank, a, b, {kinds} AS name FROM (FROM base UNION ALL SELECT n, rank, a, b FROM h GROUP BY ALL HAVING max(bits) >= {bound}) q)
        SELECT any_value(doc_id) AS doc_id, {counts},
            sha256(coalesce(string_agg({span}, ',' ORDER BY a, rank, b) FILTER (WHERE rank < {len(BASE)}), '')) AS base_sha256,
            coalesce(string_agg({span}, ',' ORDER BY a, rank, b), '') AS spans
        FROM d LEFT JOIN s USING (n) GROUP BY n
    """


def _cosine_sql() -> str:
    """The same links by comparing all pairs; components by all that can be reached."""
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        v AS MATERIALIZED (SELECT n, vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM e WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.n AS a, b.n AS b, b.vec_id FROM v a JOIN v b ON a.n <> b.n AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.r * b.r) >= {LEAST}),
        c AS (SELECT n, n AS m, vec_id FROM e UNION SELECT c.n, l.b, l.vec_id FROM c JOIN l ON l.a = c.m),
        s AS (SELECT n, min(vec_id) AS component_id FROM c GROUP BY n), k AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, s.component_id, e.vec_id IS NOT DISTINCT FROM s.component_id AS kept FROM e JOIN s USING (n) LEFT JOIN k USING (n)
    """


def _shards_sql(shards: int = 24, seed: int = 42) -> str:
    """The same places by sorting each source, and then all rows, whole; CRC-32 bit by bit."""
    step = "list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))"
    return f"""
        WITH b AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda z: CAST('0x' || z AS BIGINT)) AS z FROM documents),
        d AS (SELECT doc_id, source, len(z) + 8 AS size, xor(list_reduce(list_concat([4294967295], z), lambda x, y: {step}), 4294967295) AS crc, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s FROM b),
        h AS MATERIALIZED (SELECT *, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || size || ':' || crc)) AS h FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size, crc) AS k, count(*) OVER (PARTITION BY s) AS m FROM h),
        q AS (SELECT *, row_number() OVER (ORDER BY (CAST(k AS DOUBLE) - 0.5) / m, s, k) - 1 AS i, count(*) OVER () AS n FROM p)
        SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(i * {shards} // n AS INT) AS shard, i - (i * {shards} // n * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INT) AS grown_shard, source FROM q
    """


#: DuckDB SQL of those queries that SQL can express at a bearable cost.
ORACLES: dict[str, str] = {
    "op1_secret_scans": _secrets_sql(),
    "op3_embedding_dedup": _cosine_sql(),
    "op5_sharding": _shards_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.n > 1 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.n > 1 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to, TRUE AS intact
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op12_vector_codes": _lloyd_sql(),
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
        l AS (SELECT c, list(struct_pack(k, b) ORDER BY turn NULLS FIRST, k) AS ts FROM t GROUP BY c),
        -- CRC-32 of the decimal id, bit by bit
        h AS (SELECT *, CASE WHEN c % 5 = 0 THEN 0 ELSE xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 9 END AS h FROM l),
        r AS (SELECT a.c, list_concat(coalesce(d.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts FROM h a LEFT JOIN l d ON d.c = a.c - a.c % 5 AND a.h > 0),
        p AS MATERIALIZED (SELECT c, d, len(ts) AS n, ts[d].b AS b, sha256(d || array_to_string(list_transform(ts[1:d], lambda x: x.k), '')) AS node,
                CASE WHEN d > 0 THEN sha256(d - 1 || array_to_string(list_transform(ts[1:d - 1], lambda x: x.k), '')) END AS up FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r) q),
        n AS MATERIALIZED (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(b), 0) AS b, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY node),
        k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
        s AS (SELECT a.node, sum((x.n_convs - 1) * x.b) AS saved, count(*) FILTER (WHERE k.node IS NULL) AS leaves FROM n x JOIN p a ON a.c = x.conv_id AND a.d <= x.depth LEFT JOIN k ON k.node = x.node GROUP BY 1)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n u ON u.node = n.up
    """,
}
