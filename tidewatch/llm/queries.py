"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .chat import chat_format, chat_parse
from .dual_tree import top_k
from .exact_dedup import exact_dedup_decisions
from .html_text import main_text
from .language_id import predict_languages
from .minhash_dedup import near_dedup_decisions
from .mixing import mix_decisions
from .prefix_trie import prefix_trie
from .sentencepiece_codec import sp_digests
from .url_rules import judge_urls
from .vector_codes import ENTRIES, PARTS, ROUNDS, vector_codes
from .warc import archive_round_trip
from .wavelet import tokens_round_trip

CHAT_EXTRA = "<|im_end|><|im_start|>assistant ok"


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_EXTRA).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_parse(chat_format(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("valid").alias("valid_order"),
    )


OP2_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CHAT_EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{CHAT_EXTRA}'
), u AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS state,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS esc FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + esc + 11)::BIGINT AS formatted_chars,
  bool_and((state = '' AND role IN ('system', 'user')) OR (state = 'system' AND role = 'user')
    OR (state = 'user' AND role = 'assistant') OR (state = 'assistant' AND role = 'user')) AS valid_order
FROM u GROUP BY conv_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(str(r) for r in URL_RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)"))


OP4_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_decisions(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH k AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM k WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM g
"""


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_decisions(table(spark, sf_dir, "documents"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH e AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_decisions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 3.0 * source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM p
), e AS (SELECT *, 3 * source_size * left_w <= (total - capped) * w AS is_capped FROM c
), f AS (
  SELECT *, total - coalesce(sum(3 * source_size) FILTER (is_capped) OVER (), 0) AS rest, coalesce(sum(w) FILTER (NOT is_capped) OVER (), 1) AS rest_w FROM e
), t AS (
  SELECT source, source_size, CASE WHEN is_capped THEN (3 * source_size)::DOUBLE ELSE (w * rest)::DOUBLE / rest_w::DOUBLE END AS target,
    CASE WHEN source_size = 0 THEN 0 WHEN is_capped THEN 3 ELSE (w * rest) // (rest_w * source_size) END AS copies,
    CASE WHEN source_size = 0 OR is_capped THEN 0 ELSE (w * rest) // rest_w - ((w * rest) // (rest_w * source_size)) * source_size END AS budget FROM f
), r AS (
  SELECT d.*, t.source_size, t.target, t.copies, t.budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source,
  (size * (copies + CASE WHEN budget > 0 AND (upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    sha256(length(role) || ':' || role || text) AS f, octet_length(encode(text))::BIGINT AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT DISTINCT conv_id, xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')],
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) % 9 AS h FROM t
), r AS (
  SELECT c.conv_id, 0 AS seg, pos, f, bytes FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, f, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
), l AS MATERIALIZED (
  SELECT c.conv_id, coalesce(list(f ORDER BY seg, pos) FILTER (f IS NOT NULL), []) AS f, coalesce(list(bytes ORDER BY seg, pos) FILTER (f IS NOT NULL), []) AS b
  FROM c LEFT JOIN r USING (conv_id) GROUP BY 1
), p AS MATERIALIZED (
  SELECT conv_id, d, len(f) = d AS ends, sha256(array_to_string(f[:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(f[:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes
  FROM l, unnest(range(len(f) + 1)) AS u(d)
), n AS MATERIALIZED (
  SELECT k, min(up) AS up, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k
), kids AS (SELECT up, count(*) AS n FROM n GROUP BY up
), below AS (
  SELECT a.k, sum(n.own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM n JOIN p AS a ON a.conv_id = n.conv_id AND a.d <= n.depth LEFT JOIN kids ON kids.up = n.k GROUP BY a.k
)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN below USING (k) LEFT JOIN kids ON kids.up = n.k LEFT JOIN n AS m ON m.k = n.up
"""

def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """Every part against every entry; one pair of steps per round."""
    steps = [f"""e AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), x AS MATERIALIZED (
  SELECT vec_id, place, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM e, range({PARTS}) AS p(part)
), b0 AS MATERIALIZED (SELECT part, place AS entry, v FROM x WHERE place < {ENTRIES})"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        near = "min({'d': list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v), 'e': b.entry})"
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.place, x.part, {near} AS near FROM x JOIN b{r} AS b USING (part) GROUP BY x.place, x.part)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT part, entry, list(c ORDER BY pos) AS v FROM (
    SELECT a.part, a.near.e AS entry, pos, floor(sum(x.v[pos]) / count(*)) AS c FROM a{r} AS a JOIN x USING (place, part), range(1, len(x.v) + 1) AS i(pos) GROUP BY ALL) GROUP BY part, entry
), b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} AS b LEFT JOIN m{r} AS m USING (part, entry))""")  # fmt: skip
    return f"""WITH {", ".join(steps)}, d AS (
  SELECT e.vec_id, e.label, string_agg(printf('%02x', a.near.e), '' ORDER BY a.part) AS code, sum(a.near.d)::BIGINT AS error FROM a{ROUNDS} AS a JOIN e USING (place) GROUP BY ALL
), h AS (SELECT sha256(string_agg(array_to_string([c::BIGINT for c in v], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM d, h"""


OP12_SQL = _codes_sql()

def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


#: For pages that mark their article, and with the character references of the given tables.
OP13_SQL = r"""
WITH a AS (
  SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ') AS body FROM pages
), b AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(body, '</?(b|a)( [^>]*)?>', '', 'g'), '</?[a-z0-9]+>') AS parts FROM a
), c AS (
  SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) for x in parts] AS parts FROM b
), d AS (SELECT page_id, url, array_to_string([x for x in parts if x <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


QUERIES = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_url_rules": op4_url_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc": op7_warc,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_cover_tree": op9_cover_tree,
    "op10_mix_sources": op10_mix_sources,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_html_text": op13_html_text,
}
SQL = {"op2_chat_format": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op4_url_rules": OP4_SQL, "op7_warc": OP7_SQL, "op9_cover_tree": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_html_text": OP13_SQL}
