"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelquarry.llm.bpe import encode_digest
from pixelquarry.llm.chat_format import chat_digest, with_probe
from pixelquarry.llm.clustering import cluster
from pixelquarry.llm.common import table
from pixelquarry.llm.exact_dedup import exact_dedup
from pixelquarry.llm.language_id import identify
from pixelquarry.llm.mixing import mix_sources
from pixelquarry.llm.prefix_trie import conversation_trie
from pixelquarry.llm.simhash import simhash_components
from pixelquarry.llm.substring_dedup import repeats_digest
from pixelquarry.llm.token_counts import token_counts
from pixelquarry.llm.token_files import read_token_files, write_token_files
from pixelquarry.llm.topk_search import top_k
from pixelquarry.llm.url_filters import url_filter


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizers' file of that name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(with_probe(table(spark, sf_dir, "conversations")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(shards)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_language_id": op2_language_id,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_topk_search": op4_topk_search,
        "op5_mix_sources": op5_mix_sources,
        "op6_chat_format": op6_chat_format,
        "op7_simhash": op7_simhash,
        "op8_token_files": op8_token_files,
        "op9_url_filters": op9_url_filters,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_token_counts": op11_token_counts,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


_OP3 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

_OP4 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

# Roles that the machine takes: system at the start only, then user and assistant in turn, with
# tool turns after an assistant's; one letter a role.
_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END AS r
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
    sum(length(replace(replace(role, '<|', '<||'), chr(10), '<|n')) + length(replace(text, '<|', '<||'))
        + length('<|im_start|>') + length('<|im_end|>') + 2) AS chars,
    string_agg(r, '' ORDER BY k) AS rs
  FROM n GROUP BY conv_id
), p AS (
  SELECT *, length(regexp_extract(rs, '^(s?ua(t+a|ua)*(t+|u)?|s?u?)', 0)) AS good FROM g
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars,
       regexp_full_match(rs, 's?ua(t+a|ua)*') AS valid,
       CASE WHEN good < n_turns THEN good::INT END AS bad_turn
FROM p
"""

_OP9 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), f AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""


_OP10 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT k, p, array_to_string(ws[p:p + 34], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS p)
), h AS (
  SELECT k, p FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), c AS (
  SELECT DISTINCT k, unnest(range(p, p + 35)) AS i FROM h
), t AS (
  SELECT k, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d
), g AS (
  SELECT k, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (c.i IS NULL) AS kept
  FROM t LEFT JOIN c USING (k, i) GROUP BY k
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (k)
"""

# DuckDB has no CRC-32: eight shifts for each digit of the identifier, with the polynomial reversed.
_OP12 = r"""
WITH o AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, t, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 6 AS h
  FROM o
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, d, t[1:d] AS path, len(t) = d AS ends FROM r, LATERAL (SELECT unnest(range(0, len(t) + 1)) AS d)
), n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN (count(*) - 1) * length(path[d].text) ELSE 0 END AS saved
  FROM p GROUP BY path, d
), c AS (
  SELECT path[1:depth - 1] AS parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent
), k AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.path
), a AS (
  SELECT path[1:u] AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM k, LATERAL (SELECT unnest(range(0, depth + 1)) AS u) GROUP BY top
)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves,
  a.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN a ON a.top = k.path LEFT JOIN k q ON k.depth > 0 AND q.path = k.path[1:k.depth - 1]
"""


def _op13(rounds: int = 3) -> str:
    """Each round: the nearest centroid of each vector, and the floor of each component's mean."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS (
  SELECT (row_number() OVER (ORDER BY h, q) - 1)::INT AS c, q AS m
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 16)
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (
  SELECT k, vec_id, q, c, list_sum(list_transform(range(1, 65), lambda j: (q[j] - m[j]) * (q[j] - m[j])))::BIGINT AS distance FROM v, c{i}
), a{i} AS (
  SELECT vec_id, q, c AS cluster, distance FROM d{i}
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, c) = 1
)""")
        if i < rounds:
            steps.append(f"""s{i} AS (
  SELECT cluster, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j
), c{i + 1} AS (
  SELECT c, coalesce(f, m) AS m FROM c{i} LEFT JOIN (
    SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY j) AS f FROM s{i} GROUP BY cluster
  ) ON cluster = c
)""")
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = cluster
"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": _OP3,
        "op4_topk_search": _OP4,
        "op6_chat_format": _OP6,
        "op9_url_filters": _OP9,
        "op10_substring_dedup": _OP10,
        "op12_prefix_trie": _OP12,
        "op13_centroid_clustering": _op13(),
    }
