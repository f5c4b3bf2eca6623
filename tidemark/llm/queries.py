"""The opN_ queries: production parameters, whole tables, digest columns derived from the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.cap_filters import near_vectors
from tidemark.llm.gru_language import held_out as language_held_out, predict_languages
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources, n_words
from tidemark.llm.packing import pack_documents
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.quality_classifier import quality_scores
from tidemark.llm.quality_rules import STOP_WORDS, judge
from tidemark.llm.store import folder, table
from tidemark.llm.token_parquet import token_output
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.warc import read_pages, read_records, write_archives
from tidemark.llm.whitening import whiten
from tidemark.llm.zdict import held_out


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    decided, keys = mix_sources(docs)
    sized = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size")).alias("key"))
    known = decided.select(F.struct(*keys).alias("key"), "source_size", "target", "copies")
    return sized.join(known, "key").select(
        "key.doc_id", "key.size", "source_size", "target", (F.col("key.size") * F.col("copies")).alias("taken"), "copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _classified(scores: DataFrame, at: float) -> DataFrame:
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= at).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _classified(toxicity_scores(docs.select("doc_id", "text"), labels), 0.7)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _classified(quality_scores(docs.select("doc_id", "text"), labels), 0.5)


def op5_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    pages = read_pages(read_records(spark, path), payloads=False)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "__n", "__deviation", "__identity_error", "__explained", F.posexplode("__whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.col("__n").alias("n"), F.expr("try_cast(__deviation AS bigint)").alias("deviation"), "whitened",
        F.get("__explained", "at").alias("explained"), F.col("__identity_error").alias("identity_error"), F.col("__deviation").alias("deviation_exact"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language_held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_line_dedup, op3_jaccard_join, op4_toxicity, op5_token_parquet, op6_warc, op7_cap_filters, op8_quality_rules,
    op9_best_fit_packing, op10_quality_classifier, op11_whitening, op12_prefix_trie, op13_gru_language)}

ORACLE = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
leads AS (SELECT key, min(doc_id) AS lead FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.pos, k.line, l.lead IS NOT NULL AND l.lead <> k.doc_id AS dropped FROM keyed k LEFT JOIN leads l USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT h, max(page_id) AS target FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN t.target IS NULL OR t.target = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN t.target <> p.page_id THEN t.target END AS refers_to, TRUE AS valid
FROM p LEFT JOIN t ON p.h = t.h""",
    "op7_cap_filters": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least ON node = vec_id LEFT JOIN counts ON a = vec_id""",
    "op8_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
spans AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice),
repeats AS (SELECT doc_id, sum(n) AS n FROM spans GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, length(t) AS n_chars, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(words, lambda x: lower(x) IN (@STOP@))) AS n_stop_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeats r USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND n_symbols <= 0.1 * n_words AND n_stop_words >= 0.04 * n_words
    AND n_dup_lines <= 0.5 * n_lines AND n_chars >= 50 AS kept
FROM j""".replace("@STOP@", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))),
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(text, '') AS x, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id, bit by bit
convs AS (
  SELECT c, c - c % 5 AS a, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
parts AS (
  SELECT k.c, 0 AS own, t.pos, t.tok, t.x FROM convs k JOIN t ON t.c = k.a AND t.pos <= k.h
  UNION ALL SELECT k.c, 1, t.pos, t.tok, t.x FROM convs k JOIN t ON t.c = k.c AND t.pos > k.h),
turns AS (
  SELECT c, row_number() OVER w AS d, md5(string_agg(tok, '') OVER w) AS key, strlen(x) AS b FROM parts
  WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
pre AS (SELECT c, d, key, b FROM turns UNION ALL SELECT c, 0, md5(''), 0 FROM convs),
nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(b) AS b FROM pre GROUP BY d, key),
linked AS (SELECT n.*, p.key AS up, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN pre p ON p.c = n.conv_id AND p.d = n.d - 1 LEFT JOIN nodes q ON q.key = p.key AND q.d = p.d),
kids AS (SELECT up AS key, count(*) AS n FROM linked WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.key, count(*) FILTER (k.n IS NULL) AS leaves, sum((y.n - 1) * y.b) AS saved
  FROM nodes y JOIN pre p ON p.c = y.conv_id AND p.d <= y.d LEFT JOIN kids k ON k.key = y.key GROUP BY p.key),
ends AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, d) AS key FROM pre GROUP BY c) GROUP BY key)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n AS n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked l JOIN below b ON b.key = l.key LEFT JOIN kids k ON k.key = l.key LEFT JOIN ends e ON e.key = l.key""",
}
