"""One registered query per operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@query("op5_block_naming_exact_dedup", EXACT_SQL)
def exact(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_simhash_multi_index")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.simhash import simhash_groups

    return simhash_groups(table(spark, folder, "documents"))


@query("op9_byte_bpe_transducer")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from wavelark.llm.bpe_transducer import codec_digest

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return codec_digest(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op1_token_counts_resync")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from wavelark.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_minimum_bin_slack_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from wavelark.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_string_kernel_language_id")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.language_id import language_id

    return language_id(table(spark, folder, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
  list_aggregate([list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * k) & 31)::INTEGER, 1) FOR k IN range(4)], 'string_agg', '')
    FOR g IN range(8)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@query("op10_seekable_warc", WARC_SQL)
def archives(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, folder, "pages")).drop("url", "record_id")


REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t),
windows AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i : i + 49], ' ')) AS first FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM t),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS text, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""


@query("op6_relative_lempel_ziv_dedup", REPEATS_SQL)
def substrings(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, folder, "documents"))


@query("op7_inverted_multi_index_dedup")
def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, folder, "embeddings"))


@query("op3_boosted_candidate_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.pii import find_pii

    return find_pii(table(spark, folder, "documents"))


@query("op11_refined_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low_body,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
        lambda i: [ascii((doc_id::VARCHAR)[i:i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    ), 4294967295) % 5 = 0 AS tampered
  FROM documents
), l AS (
  SELECT *, sha256(head || body) AS leaf, sha256(head || CASE WHEN tampered THEN low_body ELSE body END) AS given FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l
), up AS (
  SELECT source, 0 AS lvl, idx, leaf AS dig, n FROM r
  UNION ALL
  SELECT source, lvl + 1, idx // 16, sha256(string_agg(dig, '' ORDER BY idx)), (n + 15) // 16
  FROM up WHERE n > 1 GROUP BY source, lvl, idx // 16, n
), subs AS (
  SELECT source, dig AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM up WHERE n = 1
), above AS (
  SELECT 0 AS lvl, idx, subroot AS dig, n FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 16, sha256(string_agg(dig, '' ORDER BY idx)), (n + 15) // 16
  FROM above WHERE n > 1 GROUP BY lvl, idx // 16, n
), runs AS (
  SELECT source, 0 AS part, lvl, idx // 16 AS run, list(dig ORDER BY idx) AS digs FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, 1, lvl, idx // 16, list(dig ORDER BY idx) FROM above WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT r.source, r.doc_id, 0 AS part, u.lvl, r.idx // (16 ** u.lvl)::BIGINT % 16 AS pos, u.digs
  FROM r JOIN runs u ON u.part = 0 AND u.source IS NOT DISTINCT FROM r.source
    AND u.run = r.idx // (16 ** (u.lvl + 1))::BIGINT
  UNION ALL
  SELECT r.source, r.doc_id, 1, u.lvl, s.idx // (16 ** u.lvl)::BIGINT % 16, u.digs
  FROM r JOIN subs s ON s.source IS NOT DISTINCT FROM r.source
  JOIN runs u ON u.part = 1 AND u.run = s.idx // (16 ** (u.lvl + 1))::BIGINT
), numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source, doc_id ORDER BY part, lvl) AS step,
    array_to_string(list_slice(digs, 1, pos), '') AS before,
    array_to_string(list_slice(digs, pos + 2, len(digs)), '') AS after
  FROM steps
), fold AS (
  SELECT doc_id, source, leaf, given AS acc, '' AS proof, 0 AS step FROM r
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, sha256(n.before || f.acc || n.after), f.proof || n.before || n.after, n.step
  FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.source IS NOT DISTINCT FROM f.source AND n.step = f.step + 1
), ends AS (
  SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY step DESC) = 1
), root AS (SELECT dig AS root FROM above WHERE n = 1)
SELECT e.doc_id, e.leaf, s.subroot, root.root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = root.root AS verified
FROM ends e JOIN subs s ON s.source IS NOT DISTINCT FROM e.source CROSS JOIN root
"""


@query("op12_nested_interval_merkle", MERKLE_SQL)
def merkle(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.merkle import manifest

    return manifest(table(spark, folder, "documents")).drop("low", "n_steps")


@query("op13_multiple_instance_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    from wavelark.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
