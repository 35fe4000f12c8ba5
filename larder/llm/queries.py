"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import bpe, decontaminate, exact_dedup, fill_middle, line_dedup, neighbours, pii, quality, secrets, sharding, simhash, spelling, suffix_dedup

#: The vocabulary of the BPE query; a parameter of its operator.
RANK_FILE = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, quality.fit(docs, labels))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir))


def one_letter_less(doc_id: int | None, word: str) -> str:
    """The word as op11's contract has it read: one in 31 lacks a letter, by a checksum of id and word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(_documents(spark, sf_dir), read_as=one_letter_less))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(neighbours.build_index(vectors, 20), vectors.filter("vec_id % 20 = 0"), 20)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.round_trip(_documents(spark, sf_dir))


#: Equal texts, as op1's contract has them.
_OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

#: Lines that five or more documents hold, as op2's contract has them.
_OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS body
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (
  SELECT doc_id, line, body, trim(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.line, k.body, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

#: Words one edit apart: equal where one letter of each, or of one of them, is left out.
_OP11_SQL = r"""
WITH RECURSIVE x AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) for i in range(256)] AS crc),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM r),
h AS (
  SELECT b.*, xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(bytes, 2 * k + 1, 2) AS BIGINT) for k in range(length(bytes) // 2)]), lambda c, y: xor(c // 256, x.crc[xor(c, y) % 256 + 1])), 4294967295) AS h FROM b, x),
k AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, pos, left(word, pos) || substr(word, pos + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM k)),
e AS (
  SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, k.word, k.n FROM d JOIN k ON d.rest = k.word
  UNION SELECT k.word, d.word, d.n FROM d JOIN k ON d.rest = k.word),
f AS (
  SELECT k.word, k.n, count(near) AS n_near, CASE WHEN max(m) >= 10 * k.n THEN arg_min(near, (-m, near)) END AS form, CASE WHEN max(m) >= 10 * k.n THEN max(m) END AS form_n
  FROM k LEFT JOIN e ON e.word = k.word GROUP BY k.word, k.n),
g AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT g.word, f.form, steps + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM g GROUP BY word) USING (word)
"""

#: Texts cut at token ends, as op13's contract has them.
_OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, len(tokens) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS d FROM t),
v AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, coalesce(array_to_string(tokens[1:low], ''), '') AS p, coalesce(array_to_string(tokens[low + 1:high], ''), '') AS m, coalesce(array_to_string(tokens[high + 1:], ''), '') AS s FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_line_dedup": op2_line_dedup, "op3_decontaminate": op3_decontaminate, "op4_simhash": op4_simhash, "op5_pii": op5_pii, "op6_bpe": op6_bpe, "op7_sharding": op7_sharding, "op8_quality": op8_quality, "op9_secrets": op9_secrets, "op10_suffix_dedup": op10_suffix_dedup, "op11_spelling": op11_spelling, "op12_neighbours": op12_neighbours, "op13_fill_middle": op13_fill_middle}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1_SQL, "op2_line_dedup": _OP2_SQL, "op11_spelling": _OP11_SQL, "op13_fill_middle": _OP13_SQL}
