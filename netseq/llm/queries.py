"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.llm import (
    filter_audit, licenses, mixing, ngram_join, ngram_model, packing, prefix_trie, quality, secrets, sharding, tokens, topk, warc,
)
from netseq.sources.readers import read_table

QUALITY_POLICY = "v2"


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = quality.ledger(docs)
    return found.select(
        "doc_id",
        *[F.col(c) for c in quality.PATHS],
        (~quality.passes("v1")).alias("base_failed"),
        quality.passes(QUALITY_POLICY).alias("kept"),
        "failed_bits",
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) > 3
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g
), p AS (
  SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1
), n AS (
  SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r
), a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM m LEFT JOIN n USING (r)
), b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 25 * n_words)::INT
    + 16 * (100 * n_symbols > 40 * n_words)::INT + 32 * (100 * n_dup_lines > 60 * n_lines)::INT AS BIGINT) AS failed_bits
  FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  failed_bits & 3 != 0 AS base_failed, failed_bits & 63 = 0 AS kept, failed_bits FROM b
"""

def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", *licenses.RESULT)


def _op4_sql() -> str:
    rules = ", ".join(
        f"('{r.label}', {r.priority}, '{r.keyword}', '{r.over_gaps}', {r.base})" for r in licenses.signatures()
    )
    gate = " OR ".join(f"contains(low, '{g}')" for g in licenses.GATE)
    levels = licenses.CONFIDENCE
    before = "ORDER BY first, last DESC, priority, label, base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    inside = " OR ".join(
        f"(priority >= {p} AND coalesce(max(CASE WHEN priority = {p} THEN last END) "
        f"OVER (PARTITION BY r {before}), -1) >= last)"
        for p in levels
    )
    score = "CASE least(best, best_base) " + " ".join(f"WHEN {p} THEN {c}" for p, c in levels.items()) + " ELSE 0 END"
    return rf"""
WITH rules(label, priority, keyword, pattern, base) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
n AS (
  SELECT r, ' ' || trim(regexp_replace(low, '{licenses.GAP}', '  ', 'g'), ' ') || ' ' AS n FROM d WHERE {gate}
), h AS (
  SELECT r, label, priority, base, regexp_extract_all(n, pattern, 1) AS ms,
    string_split(trim(regexp_replace(n, pattern, ' ' || chr(1) || ' ', 'g'), ' '), '  ') AS toks
  FROM n JOIN rules ON contains(n, ' ' || keyword || ' ')
), i AS (
  SELECT r, label, priority, base, unnest(list_filter(range(len(toks)), lambda i: starts_with(toks[i + 1], chr(1)))) AS first,
    unnest(ms) AS m FROM h
), j AS (
  SELECT r, label, priority, base, first, first + len(string_split(m, '  ')) - 1 AS last FROM i
), k AS (SELECT *, {inside} AS inside FROM j),
g AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word,
    max(first) FILTER (WHERE base) AS last_word, list(label) FILTER (WHERE base) AS bl,
    list(label) FILTER (WHERE base OR NOT inside) AS al, min(priority) FILTER (WHERE NOT inside) AS best,
    CASE WHEN count(*) FILTER (WHERE base) > 0 THEN {max(levels)} END AS best_base
  FROM k GROUP BY r
)
SELECT doc_id, CAST(len(regexp_extract_all(t, '{licenses.WORD_ANY_CASE}')) AS BIGINT) AS n_words,
  coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(bl)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(al)), ','), '') AS labels,
  CAST({score} AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r)
"""


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), p AS (
  SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(source_size * 3) OVER o, 0) AS capped, coalesce(sum(w) OVER o, 0) AS capped_w
  FROM s WHERE source_size > 0
  WINDOW o AS (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(total - capped AS DOUBLE) / CAST(all_w - capped_w AS DOUBLE) AS lv FROM p
), t AS (
  SELECT source, source_size, coalesce(least(max(CASE WHEN lv * w <= cap THEN lv END) OVER () * w, cap), cap) AS target FROM l
), u AS (
  SELECT *, floor(target / source_size) AS epochs, CAST(floor(target) - floor(target / source_size) * source_size AS BIGINT) AS budget
  FROM t
), k AS (
  SELECT d.doc_id, d.size, u.* EXCLUDE (source), d.source,
    CASE WHEN size > 0 THEN greatest(1 - CAST(len(regexp_extract_all(t, '[\x21-\x40\x5B-\x60\x7B-\x7E]')) AS DOUBLE)
      / greatest(length(t), 1), 0.1) ELSE 0.1 END AS weight,
    (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT) + 0.5::DOUBLE)
      / 1152921504606846976::DOUBLE AS unit
  FROM d LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pow(unit, 1 / weight) DESC, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k
), x AS (
  SELECT *, coalesce(epochs * size, 0) + CASE WHEN budget > 0 AND size > 0 THEN greatest(least(budget - (upto - size), size), 0) ELSE 0 END AS taken
  FROM c
)
SELECT doc_id, size, coalesce(source_size, 0) AS source_size, coalesce(target, 0) AS target, CAST(taken AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN ceil(taken / size) ELSE 0 END AS INTEGER) AS copies
FROM x
"""


# Bytes of a shard: below all of the tables at hand, so that every run splits, over several rounds where they are large.
OP9_SHARD_BYTES = 256 << 10


def op9_hash_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(read_table(spark, folder, "documents"), limit=OP9_SHARD_BYTES)
    return placed.withColumnRenamed("key", "doc_id")


# Every prefix of every row is a candidate; the shortest one within the limit is the bucket, or the longest if none is.
OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    list_aggregate(list_transform(string_split(substr(md5(doc_id::VARCHAR), 1, 6), ''),
      lambda h: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101',
        '1110', '1111'][CAST('0x' || h AS INTEGER) + 1]), 'string_agg', '') AS bits
  FROM documents
), p AS (SELECT doc_id, n_bytes, unnest(range({sharding.KEY_BITS} + 1)) AS n, bits FROM d),
s AS (SELECT substr(bits, 1, n) AS shard, sum(n_bytes) AS b, count(*) AS c FROM p GROUP BY 1),
m AS (
  SELECT doc_id, p.n_bytes, min(n) AS shard_depth, arg_min(shard, n) AS shard, arg_min(b, n) AS shard_bytes, arg_min(c, n) AS shard_rows
  FROM p JOIN s ON s.shard = substr(bits, 1, n) WHERE b <= {OP9_SHARD_BYTES} OR n = {sharding.KEY_BITS} GROUP BY doc_id, p.n_bytes
)
SELECT doc_id, n_bytes, shard, CAST(shard_depth AS INTEGER) AS shard_depth, CAST(shard_bytes AS BIGINT) AS shard_bytes,
  CAST(shard_rows AS BIGINT) AS shard_rows, shard_bytes > {OP9_SHARD_BYTES} AS oversized FROM m
"""


def op8_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(read_table(spark, folder, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, payload_bytes, hex, list_aggregate(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(
      (((CAST('0x' || substr(hex, 1 + CAST(5 * i // 4 AS BIGINT), 2) AS INTEGER)) << CAST(5 * i % 4 AS INTEGER)) >> 3) & 31 AS INTEGER)]),
    'string_agg', '') AS payload_digest FROM p
), f AS (SELECT hex, min(page_id) AS first FROM b GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b JOIN f USING (hex)
"""


def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(read_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = ngram_join.jaccard_components(docs, ngram_join.Measure(words=3, percent=90))
    return found.drop("digest")


def op11_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_model.score(read_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id AS e FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
m AS (
  SELECT r, doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(e, false) AS e
  FROM w
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT m.*, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM m LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY ALL
), o AS (
  SELECT a || b || c || d || e AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(b),
    (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) y(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) z(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) u(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), s AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0) AS INTEGER) AS gone
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), x AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
    sum(n) FILTER (WHERE bits & (gone | bit) = 0) AS kept,
    sum(n) FILTER (WHERE bits & gone = 0 AND bits & bit != 0) AS removed,
    sum(n) FILTER (WHERE bits & gone != 0 AND bits & bit != 0) AS redundant,
    sum(n) FILTER (WHERE bits = bit) AS unique_fails,
    sum(n_good) FILTER (WHERE bits & gone = 0 AND bits & bit != 0) AS good_lost,
    sum(n_toxic) FILTER (WHERE bits & gone = 0 AND bits & bit != 0) AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM x
"""


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, folder, "conversations"))


# A node is written out as the turns that lead to it, with their lengths.
OP13_SQL = """
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(length(role) || ':' || role || length(text) || ':' || text ORDER BY n) AS own, list(length(text) ORDER BY n) AS own_points
  FROM o GROUP BY conv_id
), h AS (
  SELECT *, CAST(xor(list_reduce(
    [4294967295::BIGINT] || list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT),
    lambda x, b: list_reduce([xor(x, b)] || range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 AS INTEGER) AS h
  FROM c
), r AS (
  SELECT h.conv_id, coalesce(b.own[1:h.h], []) || coalesce(h.own[h.h + 1:], []) AS turns,
    coalesce(b.own_points[1:h.h], []) || coalesce(h.own_points[h.h + 1:], []) AS points
  FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, turns, points, unnest(range(len(turns) + 1)) AS depth FROM r
), q AS (
  SELECT conv_id, depth, array_to_string(turns[1:depth], '') AS node, CASE WHEN depth > 0 THEN array_to_string(turns[1:depth - 1], '') END AS parent,
    CASE WHEN depth > 0 THEN points[depth] ELSE 0 END AS points, depth = len(turns) AS ends FROM p
), n AS (
  SELECT depth, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(points) AS points,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY depth, node
), k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
t AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
a AS (
  SELECT q.depth, q.node, sum((t.n_children = 0)::INT) AS n_leaves, sum((t.n_convs - 1) * t.points) AS saved_tokens
  FROM t JOIN q ON q.conv_id = t.conv_id AND q.depth <= t.depth GROUP BY q.depth, q.node
)
SELECT t.conv_id, t.depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
  CAST(a.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM t JOIN a USING (depth, node) LEFT JOIN t u ON u.depth = t.depth - 1 AND u.node = t.parent
"""


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_license_scans": op4_license_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scans": op6_secret_scans,
    "op7_sequence_packing": op7_sequence_packing,
    "op8_exact_topk": op8_exact_topk,
    "op9_hash_sharding": op9_hash_sharding,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_ngram_scores": op11_ngram_scores,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {
    "op1_source_mixing": OP1_SQL,
    "op3_arc_to_warc": OP3_SQL,
    "op4_license_scans": _op4_sql(),
    "op5_quality_rules": OP5_SQL,
    "op8_exact_topk": OP8_SQL,
    "op9_hash_sharding": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
