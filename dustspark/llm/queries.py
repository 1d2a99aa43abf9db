"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.llm import collocations, ids, lines, mixing, packing, periodic, piece_bpe, quality, secrets, simhash, syncmers, toxicity, warc
from dustspark.llm.common import read


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(quality.measure(read(spark, folder, "documents")))
    return judged.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "failed_rules")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels")))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), with_ids=False)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.mark(read(spark, folder, "documents")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", F.size("deleted").cast("long").alias("n_deleted"),
        F.concat_ws(",", F.transform("deleted", lambda x: x.cast("string"))).alias("deleted"), "text")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(read(spark, folder, "documents"))


def op7_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprint_edits(read(spark, folder, "documents"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return ids.round_trip(read(spark, folder, "documents"), with_ids=False)


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find(read(spark, folder, "documents")).select(F.col("doc.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.round_trip(read(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.detect(read(spark, folder, "documents"), periodic.tail_repeated, texts=False)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_toxicity, op3_packing, op4_simhash, op5_line_dedup, op6_mixing, op7_syncmers, op8_token_files,
    op9_secret_scan, op10_warc, op11_piece_bpe,
    op12_periodic_runs, op13_collocations)}


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    rules = []
    for name, metric, least, most in quality.RULES:
        bad = ([f"{metric} < {least}"] if least is not None else []) + ([f"{metric} > {most}"] if most is not None else [])
        rules.append(f"CASE WHEN {' OR '.join(bad)} THEN '{name}' END")
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {quality.WINDOW - 2}, 1))) AS i FROM w WHERE len(ws) >= {quality.WINDOW}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+{quality.WINDOW - 1}], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS k FROM g WHERE n > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS lines,
    length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, len(list_filter(ws, lambda x: list_contains([{stop}], lower(x)))) AS stops,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS ellipses FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, word_chars::DOUBLE / nullif(n_words, 0) AS mean_word_length, n_symbols::DOUBLE / nullif(n_words, 0) AS symbols_per_word,
    bangs::DOUBLE / nullif(n_words, 0) AS exclamations_per_word, stops::DOUBLE / nullif(n_words, 0) AS stop_word_ratio,
    n_dup_lines::DOUBLE / nullif(lines, 0) AS dup_line_ratio, bullets::DOUBLE / nullif(lines, 0) AS bullet_line_ratio,
    ellipses::DOUBLE / nullif(lines, 0) AS ellipsis_line_ratio FROM m),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {", ".join(rules)}) AS failed_rules FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


SQL: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op6_mixing": mixing.SQL, "op13_collocations": collocations.sql()}
