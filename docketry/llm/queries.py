"""The thin queries over the operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import chat, classifier, decontaminate, lm, mixing, rules, secrets, sharding, simhash, tokens
from docketry.llm.base import table

N_SHARDS = 24


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the voting rules."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the bigram counts of all others, rounded as SQL can match."""
    found = lm.score(table(spark, sf_dir, "documents"), order=2)
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards by rendezvous hashing of doc_id."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in wavelet files, read back."""
    import public_tokenizers

    return tokens.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded by a model of the labels."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned for secrets."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for all benchmark items."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read(own.unionByName(probe))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline  # beside the package, not in it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_lm": op2_lm,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_tokens": op5_tokens,
    "op6_simhash": op6_simhash,
    "op7_classifier": op7_classifier,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "pipeline": pipeline,
}

WORD_SQL = r"'[^\x20\x09-\x0D]+'"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, {WORD_SQL}), []) AS w FROM documents),
p AS (SELECT r, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
one AS (SELECT r, b, count(*) AS own FROM p GROUP BY r, b), two AS (SELECT r, a, b, count(*) AS own FROM p WHERE a IS NOT NULL GROUP BY r, a, b),
all_one AS (SELECT b, sum(own) AS n FROM one GROUP BY b), all_two AS (SELECT a, b, sum(own) AS n FROM two GROUP BY a, b),
c1 AS (SELECT r, b, n - own AS c FROM one JOIN all_one USING (b)), c2 AS (SELECT r, a, b, n - own AS c FROM two JOIN all_two USING (a, b)),
s AS (SELECT p.r, CASE WHEN c2.c > 0 AND ca.c > 0 THEN ln(c2.c / ca.c)
    ELSE ln(CASE WHEN cb.c > 0 THEN cb.c ELSE 0.5 END / greatest((SELECT count(*) FROM p) - len(d.w), 1)) + CASE WHEN p.a IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END AS v
  FROM p JOIN d ON d.r = p.r JOIN c1 cb ON cb.r = p.r AND cb.b = p.b LEFT JOIN c1 ca ON ca.r = p.r AND ca.b = p.a LEFT JOIN c2 ON c2.r = p.r AND c2.a = p.a AND c2.b = p.b),
t AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(v / len(w), 6) END AS mean_log_score FROM d LEFT JOIN t USING (r)"""

OP4 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD_SQL})), 0)::BIGINT AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':7')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (6 // weight), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY source_size * (6 // weight), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM w),
c AS (SELECT *, source_size * 3 * left_ <= weight * (total - before) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
  ELSE weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
q AS (SELECT *, CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT // source_size ELSE 0 END AS whole, round_even(target, 0)::BIGINT AS quota FROM t),
x AS (SELECT d.*, source_size, target, whole, quota - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
y AS (SELECT *, (whole + CASE WHEN rest > 0 AND start < rest AND 2 * start + size <= 2 * rest THEN 1 ELSE 0 END)::INT AS copies FROM x)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies, source FROM y"""

OP3 = f"""
WITH RECURSIVE g(i, c, n) AS (SELECT i, i, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM g WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM g WHERE n = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
u AS (SELECT r, s, -1.0 / ln((('0x' || substr(md5(concat(k, ':', CAST(s // 4 AS VARCHAR))), 1 + 8 * (s % 4), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS score FROM d, range({N_SHARDS + 1}) AS x(s)),
a AS (SELECT r, arg_max(s, score) FILTER (s < {N_SHARDS}) AS shard, arg_max(s, score) AS grown FROM u GROUP BY r)
SELECT doc_id, (octet_length(encode(text)) + 8)::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32, octet_length(encode(text))) - 1 AS slot, grown::INT AS grown_shard
FROM d JOIN a USING (r) JOIN crc USING (r)"""

_ESCAPED = "(" + "|".join(c[0].replace("[", r"\[").replace("|", r"\|") + r"\\*" + c[1:].replace("[", r"\[").replace("]", r"\]").replace("|", r"\|") for c in chat.INSTRUCT.controls) + ")"
_MARKS = " ".join(f"WHEN '{k}' THEN {len(r.before) + len(r.after)}" for k, r in chat.INSTRUCT.roles.items())
_OTHER = len(chat.INSTRUCT.other_open + chat.INSTRUCT.other_close + chat.INSTRUCT.other_after)
OP10 = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS state, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(coalesce(role, ''), chr(10), text, chr(10)), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) + CASE role {_MARKS} ELSE {_OTHER} + CASE WHEN role IS NULL THEN 0 ELSE length(role) + 1 END END)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN state IN ('system', 'assistant') THEN role = 'user' WHEN state = 'user' THEN role = 'assistant' ELSE false END) AS order_ok
FROM m GROUP BY conv_id"""

#: Where SQL has the functions it takes (XXH64, tokenizers, alignment and training, and with
#: them the pipeline, it has not).
ORACLES: dict[str, str] = {"op2_lm": OP2, "op3_sharding": OP3, "op4_mixing": OP4, "op10_chat": OP10}
