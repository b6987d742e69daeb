"""SQL for DuckDB of those queries that it can express over whole tables."""

from __future__ import annotations

from functools import reduce

_NIBBLES = [reduce(lambda c, _: (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1, range(4), i) for i in range(16)]  # crc32, half a byte at a time
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text expression."""
    halves = f"regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '.')"  # low half first
    numbers = f"list_transform({halves}, lambda d: (strpos('0123456789ABCDEF', d) - 1)::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda c, d: xor({_NIBBLES}[(xor(c, d) & 15) + 1], c >> 4), 4294967295::BIGINT), 4294967295::BIGINT)"


SHARDING = f"""
WITH measured AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents
), summed AS (
  SELECT *, row_number() OVER every - 1 AS position,
    sum(size) OVER (every ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total
  FROM measured WINDOW every AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)
), cut AS (
  SELECT *, least((40 * (2 * upto - size)) // (2 * total), 39)::INT AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, position - min(position) OVER (PARTITION BY shard) AS slot,
  NULL::INT AS grown_shard, position
FROM cut
"""


def _features(table: str, id: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"SELECT {id} AS id, seq, len(w) AS n_words, unnest(w || {pairs}) AS feature FROM (SELECT *, row_number() OVER () AS seq, {words} AS w FROM {table})"


RESAMPLING = f"""
WITH grams AS MATERIALIZED ({_features("documents", "doc_id")}),
aims AS MATERIALIZED ({_features("benchmark", "item_id")}),
hashed AS MATERIALIZED (
  SELECT feature, {crc32("feature")} % 10000 AS bucket FROM (SELECT feature FROM grams UNION SELECT feature FROM aims)
), s AS (SELECT bucket, count(*) AS s FROM grams JOIN hashed USING (feature) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (feature) GROUP BY bucket
), gains AS (
  SELECT b.range AS bucket, floor(1000 * ln(
      ((coalesce(t, 0) + 1) * ((SELECT count(*) FROM grams) + 10000)::DOUBLE)
      / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM aims) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range
), sums AS (
  SELECT seq, any_value(n_words) AS n_words, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM grams JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY seq
), every AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || left(sha256('7:' || doc_id), 8))::BIGINT AS h
  FROM (SELECT doc_id, row_number() OVER () AS seq FROM documents) LEFT JOIN sums USING (seq)
), scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM every
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS able
  FROM scored WHERE n_words >= 20 AND score IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (25 * able) // 100 THEN place END AS rank, n_words FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL, n_words FROM scored WHERE n_words < 20 OR score IS NULL
"""
