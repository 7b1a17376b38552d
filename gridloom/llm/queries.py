"""The corpus operators' queries and, where SQL can state them, their reference SQL."""

from __future__ import annotations

from gridloom.llm.best_fit import op8_best_fit
from gridloom.llm.block_join import op4_block_join
from gridloom.llm.html_text import op12_html_text
from gridloom.llm.importance_resample import op11_importance_resample
from gridloom.llm.language_id import op2_language_id
from gridloom.llm.license_rules import op5_license_rules
from gridloom.llm.mixing import op6_entropy_mix
from gridloom.llm.norm_buckets import op7_norm_buckets
from gridloom.llm.order_minhash import op9_order_minhash
from gridloom.llm.secret_links import op10_secret_links
from gridloom.llm.shard_table import SHARDS, SIZE, claimed_slots, op3_shard_table
from gridloom.llm.spelling import op13_spelling_variants
from gridloom.llm.warc_index import op1_warc_index

QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_language_id": op2_language_id,
    "op3_shard_table": op3_shard_table,
    "op4_block_join": op4_block_join,
    "op5_license_rules": op5_license_rules,
    "op6_entropy_mix": op6_entropy_mix,
    "op7_norm_buckets": op7_norm_buckets,
    "op8_best_fit": op8_best_fit,
    "op9_order_minhash": op9_order_minhash,
    "op10_secret_links": op10_secret_links,
    "op11_importance_resample": op11_importance_resample,
    "op12_html_text": op12_html_text,
    "op13_spelling_variants": op13_spelling_variants,
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # of base32
# 40 hexadecimal digits of the SHA-1, 20 bits at a time, as 32 letters; the capture time follows the page id.
WARC_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         regexp_replace(coalesce(url, ''), ' ', '%20', 'g') AS url FROM pages
), q AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}', 1 + (
           (('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
         lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)', 1)) AS host,
         lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)', 2)) AS path FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest,
         array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www[.]', ''), '.')), ',')
           || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key FROM q
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to, url_key,
       row_number() OVER (PARTITION BY url_key ORDER BY page_id % 2147483648, page_id) AS capture_no
FROM r
"""

NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0))
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
    list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d
) WHERE rank <= 10
"""

PRODUCTS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: floor(256 * e)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d
) WHERE rank <= 5
"""


# CRC-32 of each text of table ``t`` (column x): a table of 256 values by rule, then one step per byte.
CRC_TABLE_SQL = "list_transform(range(256), lambda b: list_reduce(range(8), lambda v, i: " \
    "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b))"


def crc_sql(x: str) -> str:
    """CRC-32 of the UTF-8 bytes of column ``x`` by the table ``crc.step``."""
    byte = f"('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2))::BIGINT"
    step = f"xor(v >> 8, step[1 + (xor(v, {byte}) & 255)::INT])"
    return f"xor(list_reduce(range(octet_length(encode({x}))), lambda v, i: {step}, 4294967295::BIGINT), 4294967295)"


RESAMPLE_SQL = rf"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS step),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS word FROM benchmark),
dw AS (SELECT unnest(words) AS word FROM d),
distinct_words AS (SELECT word FROM dw UNION SELECT word FROM b),
hashed AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM distinct_words, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM b) AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
         FROM s LEFT JOIN t USING (bucket), totals),
one AS (SELECT row_number() OVER () AS no, doc_id, words, len(words) AS n_features,
          ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
weights AS (SELECT no, sum(gain)::BIGINT AS weight FROM (SELECT no, unnest(words) AS word FROM one) JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY no),
scored AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM one LEFT JOIN weights USING (no)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


# Words one edit apart share a pattern with one letter left out (replaced), or one is the other without a letter.
SPELLING_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE_SQL} AS step),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
low AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
keyed AS (SELECT run, n, id || ':' || run AS k FROM low),
hashed AS (SELECT run, n, {crc_sql("k")} AS h FROM keyed, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM holes a JOIN v ON v.word = a.head || a.tail
  UNION SELECT v.word, b.word, b.n FROM holes b JOIN v ON v.word = b.head || b.tail
),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS other_n FROM near GROUP BY word),
named AS (SELECT best.word, best.n_near, best.other_n, min(near.other) AS other FROM best JOIN near ON near.word = best.word AND near.other_n = best.other_n GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
             CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN named ON named.word = v.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at AND f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word
JOIN f last ON last.word = walk.at AND last.form IS NULL
"""


def _shard_sql() -> str:
    """Placement over the given slot owners; how the slots are claimed is tested on its own."""
    owners = ",".join(map(str, claimed_slots(SHARDS, SIZE)))
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owner, [{names}] AS names),
h AS (SELECT doc_id, source, n_chars,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE})::INT AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, names[owner[slot + 1]::INT + 1] AS shard FROM h, t
"""


# The other operators learn, iterate or look around matches, which SQL cannot state; their tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": WARC_SQL, "op3_shard_table": _shard_sql(), "op4_block_join": NEAREST_SQL, "op7_norm_buckets": PRODUCTS_SQL,
    "op11_importance_resample": RESAMPLE_SQL, "op13_spelling_variants": SPELLING_SQL,
}
