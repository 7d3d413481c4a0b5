"""One query per operator over its whole driver table, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import chat, exact_dedup, fingerprints, language_id, license_scan, minhash_dedup, quality, secrets, sentencepiece_codec, source_divergence, source_mix, token_alignment, toxicity
from riskframe.llm.common import LOWER, UPPER, held_out, read_table, small_batches

#: Vocabulary file of the public BPE tokenizer; any other SentencePiece model may be given by path.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Vocabulary file of a byte-level BPE tokenizer.
BYTE_BPE = os.environ.get("BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


@_query("op1_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(read_table(spark, sf_dir, "documents"), keep="largest")


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    dictionaries = language_id.fit_dictionaries(docs, modulus=4, remainder=2)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return language_id.identify_language(rows, dictionaries).drop("text")


@_query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(read_table(spark, sf_dir, "documents"), finer=True)


@_query("op4_near_dedup", f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [[ws[1]]]
        ELSE list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rep AS (SELECT min(doc_id) AS rep, gs FROM (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id) GROUP BY gs),
cls AS (SELECT x.doc_id, rep.rep FROM (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id) AS x JOIN rep USING (gs)),
r AS (SELECT s.* FROM s WHERE doc_id IN (SELECT rep FROM rep)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r AS a JOIN r AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT a, b FROM links JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach AS (SELECT rep AS x, rep AS y FROM rep UNION SELECT reach.x, near.b FROM reach JOIN near ON near.a = reach.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id, w.doc_id = coalesce(comp.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.x = cls.rep
""")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash_dedup.label_near_copies(read_table(spark, sf_dir, "documents"), words=2)


@_query("op5_mix_sources", """
WITH RECURSIVE
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
quota AS (SELECT source, greatest(1, CAST(floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) + 0.5) AS BIGINT)) AS q FROM sizes),
srcs AS (SELECT list(source ORDER BY source) AS ss, list(q ORDER BY source) AS qs, CAST(sum(q) AS BIGINT) AS h FROM quota),
edf AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS nxt, CAST(NULL AS BIGINT) AS pick, qs, ss, h FROM srcs
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda k, i: CASE WHEN i = p THEN k + 1 ELSE k END), p, qs, ss, h
  FROM (SELECT *, list_min(list_filter(list_transform(qs, lambda q, i: CASE WHEN (nxt[i] * h) // q <= t
          THEN (((nxt[i] + 1) * h + q - 1) // q) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS p FROM edf WHERE t < h)
),
pat AS (SELECT ss[pick] AS source, qs[pick] AS q, h, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j
        FROM edf WHERE pick IS NOT NULL),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k FROM documents),
blk AS (SELECT doc_id, r.source, CAST(k // 64 AS BIGINT) AS b, CAST(k % 64 AS INTEGER) AS o, quota.q FROM ranked r JOIN quota USING (source))
SELECT doc_id, blk.source, b AS mix_block, CAST((b * h) // blk.q AS BIGINT) AS mix_release,
       CAST(((b + 1) * h + blk.q - 1) // blk.q AS BIGINT) AS mix_deadline,
       CAST((b // blk.q) * h + slot AS BIGINT) AS mix_slot, o AS mix_offset
FROM blk JOIN pat ON pat.source = blk.source AND pat.j = b % blk.q
""")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source"))


@_query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, "quality", ~held_out(F.col("doc_id"), 3, 1))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    scored = quality.score_quality(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op7_chat_format", """
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS ts, count(*) AS n FROM conversations GROUP BY conv_id),
     f AS (SELECT ts, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts, n),
     m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS g WHERE g.n > f.n AND g.ts[1] = f.ts[1] AND g.ts[1:f.n] = f.ts))
SELECT conv_id, CAST(0 AS INTEGER) AS part, CAST(1 AS INTEGER) AS n_parts, n AS n_turns, n_copies,
       array_to_string(list_transform(ts, lambda x: '<|im_start|>' || replace(replace(x.r, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
         || replace(replace(x.t, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10)), '') AS rendered
FROM m
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


@_query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs.select("doc_id", "text"), secrets.corpus_words(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
                        "spans", "n_novel")


@_query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load_pieces(PIECE_MODEL)).drop("text")


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    scored = toxicity.fit_and_score(rows, labels, "toxic", ~held_out(F.col("doc_id"), 4, 2))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align_tokens(docs, token_alignment.load_tokenizers(BYTE_BPE, PIECE_MODEL))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return token_alignment.link_support(aligned.withColumn("groups_sha256", digest).drop("groups")).drop("row_id")


@_query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    span = lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])
    return found.withColumn("spans", F.concat_ws(",", F.transform("spans", span)))


@_query("op13_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS (SELECT u, lang, source, unnest(ts) AS t FROM d),
kept AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(DISTINCT u) >= 30),
c AS (SELECT lang, source, t, count(*) AS n FROM o JOIN kept USING (lang, t) GROUP BY lang, source, t),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
x AS (SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n, v.v,
        sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
p AS (SELECT lang, source, t, n, v, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (total + 5 * v) AS p FROM x),
l AS (SELECT lang, t, v, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM p GROUP BY lang, t, v),
q AS (SELECT lang, t, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (total + 5 * v) AS q FROM l),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source
         GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return source_divergence.audit_sources(read_table(spark, sf_dir, "documents"), min_df=30, top_terms=50)
