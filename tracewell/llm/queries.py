"""The thin queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat, decontam, neardup, passages, quality, sharding, topk, warc
from tracewell.llm.common import read_table
from tracewell.llm.linededup import LineStore

#: Rank files of public tokenizers, at the same place on every machine.
MULTI_RANKS, CHAT_RANKS = (public_tokenizers.path(f"{name}.tiktoken") for name in ("byte_bpe_multi_50k", "byte_bpe_50k"))
PATTERN = public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 24)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), MULTI_RANKS, PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return LineStore(spark).insert(docs).dedup(docs, digest=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(read_table(spark, sf_dir, "conversations"))
    return chat.digest_conversations(turns, CHAT_RANKS, PATTERN)


QUERIES = {
    "op1_sharding": op1_sharding, "op2_topk": op2_topk, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_warc": op5_warc,
    "op6_passages": op6_passages,
    "op7_line_dedup": op7_line_dedup, "op8_decontamination": op8_decontamination, "op9_near_dedup": op9_near_dedup, "op10_chat": op10_chat,
}

_SHARD = "(SELECT arg_min(s, (-ln((('0x' || substr(md5('shard:' || s || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE), s)) FROM range({n}) AS t(s))"

OP1_SQL = f"""
WITH RECURSIVE bits(n, v, k) AS (
  SELECT n, n, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(v ORDER BY n) AS step FROM bits WHERE k = 8),
bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
sized AS (
  SELECT doc_id, (len(b) + 8)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: ('0x' || x)::BIGINT)),
      lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM bytes, crc
),
placed AS (SELECT *, {_SHARD.format(n=24)}::INTEGER AS shard, {_SHARD.format(n=25)}::INTEGER AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM placed
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 5
"""

OP5_SQL = """
WITH hexed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
digits AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS twenty FROM hexed),
spelt AS (
  SELECT page_id, payload_bytes, h,
    list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((twenty[(j // 4) + 1] >> (15 - 5 * (j % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest
  FROM digits
),
held AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM spelt)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM held
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, line, n, coalesce(doc_id <> holder, false) AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_ESCAPED = "t"
for _c in chat.CONTROL:
    _head, _tail = _c[0], _c[1:]
    _quote = lambda s: "".join("\\" + c if not c.isalnum() and c not in "<>/_ " else c for c in s)
    _ESCAPED = rf"regexp_replace({_ESCAPED}, '{_quote(_head)}(\\*{_quote(_tail)})', '{_head}\\\1', 'g')"

OP10_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (SELECT *, length({_ESCAPED}) + length({_ESCAPED.replace("(t,", "(role,")}) + {len(chat.TURN + chat.BODY + chat.END)} AS chars FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLES = {"op1_sharding": OP1_SQL, "op2_topk": OP2_SQL, "op5_warc": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_chat": OP10_SQL}
