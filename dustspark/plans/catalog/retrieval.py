"""Text cleaning, chunking and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import text as T
from dustspark.operators import retrieval as B
from dustspark.plans.catalog.base import CTES, query, rounded, sql
from dustspark.session import scratch
from dustspark.sources import fixtures as X
from dustspark.sources import index as IX


def asked(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_BODY = "h0 AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', chr(1), 'gs') AS h FROM pages)"
_TAGS = ("h1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<script\\b.*?</script\\s*>', chr(1), 'gsi'), "
         "'<style\\b.*?</style\\s*>', chr(1), 'gsi'), '<noscript\\b.*?</noscript\\s*>', chr(1), 'gsi'), '<svg\\b.*?</svg\\s*>', chr(1), 'gsi'), '<[^>]+>', chr(1), 'gs') AS h FROM h0)")
_DECODE = "h"
for _e, _c in T.ENTITIES:
    _DECODE = f"replace({_DECODE}, '{_e.replace(chr(39), chr(39) * 2)}', '{_c.replace(chr(39), chr(39) * 2)}')"
_TEXT = f"""h2 AS (SELECT page_id, regexp_replace(array_to_string(list_filter(list_transform(string_split({_DECODE}, chr(1)), lambda f: {_STRIP.format('f')}), lambda f: length(f) > 0), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM h1)"""


@query("s9_html_text", "S9", f"WITH {_BODY}, {_TAGS}, {_TEXT} SELECT page_id, text FROM h2")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return X.pages(spark, d).select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("s10_markdown_links", "S10 X26", f"""SELECT doc_id, md5({_STRIP.format("regexp_replace(regexp_replace(regexp_replace(md, '\\]\\(https?://[^)]+\\)', ']', 'g'), '\\[Image \\d+[^\\]]*\\]', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g')")}) AS digest
    FROM (SELECT doc_id, '[link](https://a.example/' || doc_id || ') ' || chr(10)||chr(10)||chr(10)||chr(10) || text || ' [Image ' || doc_id || ': x]' AS md FROM documents)""")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    md = F.concat(F.lit("[link](https://a.example/"), F.col("doc_id").cast("string"), F.lit(") \n\n\n\n"), "text", F.lit(" [Image "),
                  F.col("doc_id").cast("string"), F.lit(": x]"))
    return X.documents(spark, d).select("doc_id", F.md5(T.strip_markdown(md)).alias("digest"))


@query("x23_tokens", "X23", sql("tok", "SELECT doc_id, CAST(len(toks) AS INTEGER) AS dl, md5(array_to_string(toks, ' ')) AS digest FROM tok"))
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return B.tokenized(X.documents(spark, d)).select("doc_id", "dl", F.md5(F.array_join("toks", " ")).alias("digest"))


@query("x24_fixed_chunks", "X24", f"""WITH b AS (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents), p AS (SELECT doc_id, CAST(s // 1050 AS INTEGER) AS pos, {_STRIP.format('substr(t, s+1, 1200)')} AS piece FROM (SELECT doc_id, t, unnest(range(0, length(t), 1050)) AS s FROM b))
    SELECT doc_id, pos, length(piece) AS chars, md5(piece) AS digest FROM p WHERE length(piece) > 0""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return B.chunk_fixed(X.documents(spark, d)).select("doc_id", "pos", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("x25_word_chunks", "X25", """WITH RECURSIVE h AS (SELECT page_id, regexp_replace(regexp_replace(html, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS b FROM pages),
    cut AS (SELECT page_id, 0 AS pos, 0 AS s, CASE WHEN length(b) <= 1400 THEN length(b) WHEN strpos(reverse(substr(b, 951, 250)), ' ') > 0 THEN 1200-strpos(reverse(substr(b, 951, 250)), ' ') ELSE 1200 END AS e FROM h
      UNION ALL SELECT page_id, pos+1, s2, CASE WHEN s2+1200 >= n THEN n WHEN strpos(reverse(substr(b, s2+951, 250)), ' ') > 0 THEN s2+1200-strpos(reverse(substr(b, s2+951, 250)), ' ') ELSE s2+1200 END
      FROM (SELECT c.*, greatest(c.e-150, c.s+1) AS s2, b, length(b) AS n FROM cut c JOIN h USING (page_id) WHERE c.e < length(b)))
    SELECT page_id, pos, length(piece) AS chars, md5(piece) AS digest FROM (SELECT page_id, pos, trim(substr(b, s+1, e-s)) AS piece FROM cut JOIN h USING (page_id)) WHERE length(piece) >= 60""")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = X.pages(spark, d).select("page_id", F.col("html").alias("text"))
    return B.chunk_pages(pages).select("page_id", "pos", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("x26_squeeze", "X26", f"SELECT doc_id, length({_STRIP.format(chr(34) + 'a' + chr(34))}) AS flat_chars, length(b) AS layout_chars FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS a, regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10)||chr(10), 'g') AS b FROM documents)")
def squeeze(spark: SparkSession, d: str) -> DataFrame:
    return X.documents(spark, d).select("doc_id", F.length(T.squeeze_spaces(F.col("text"))).cast("long").alias("flat_chars"),
                                        F.length(T.squeeze_layout(F.col("text"))).cast("long").alias("layout_chars"))


@query("b1_postings", "B1", sql("posts", "SELECT doc_id, term, tf, CAST(dl AS INTEGER) AS dl FROM posts"))
def postings(spark: SparkSession, d: str) -> DataFrame:
    """Every posting: how often a term is in a document, and the document's length."""
    return B.postings(X.documents(spark, d)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("int").alias("dl"))


@query("b2_idf", "B2", sql("idfs", "SELECT term, df, round(idf,6) AS idf FROM idfs"))
def idf(spark: SparkSession, d: str) -> DataFrame:
    index = B.build_index(X.documents(spark, d))
    return rounded(B.with_idf(index.terms, index.stats), 6)


_OLD, _NEW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


_HIT_COLS = "SELECT query_id, doc_id, round(score,3) AS score, pos FROM hits"


@query("b3_bm25_search", "B3 T2", sql("hits", _HIT_COLS))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.search_documents(X.documents(spark, d), asked(spark, d)), 3)


@query("b3_indexed_search", "B3", sql("hits", _HIT_COLS))
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.search(B.build_index(X.documents(spark, d)), asked(spark, d)), 3)


@query("b5_refreshed_index", "B5 B3", sql("hits", _HIT_COLS))
def refreshed_index(spark: SparkSession, d: str) -> DataFrame:
    """The index is built on other texts for half of the sources, then refreshed with the real ones."""
    docs = X.documents(spark, d).select("doc_id", "text", F.col("source").alias("file"))
    half = F.pmod(F.xxhash64("file"), F.lit(2)) == 0
    before = docs.withColumns({"modified": F.lit(_OLD).cast("timestamp"),
                               "text": F.when(half, F.lower(F.reverse("text"))).otherwise(F.col("text"))})
    after = docs.withColumn("modified", F.when(half, F.lit(_NEW)).otherwise(F.lit(_OLD)).cast("timestamp"))
    folder = scratch(spark)
    IX.refresh(before, folder)
    IX.refresh(after, folder)
    return rounded(B.search(IX.load_index(after, folder), asked(spark, d)), 3)


@query("q7_context_blocks", "Q7 B4 W16", sql("hits", """, h AS (SELECT query_id, pos, source, CASE WHEN h.doc_id % 5 = 0 THEN NULL ELSE h.doc_id % 5 END AS page, text,
      coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hits h JOIN documents d ON d.doc_id = h.doc_id)
    SELECT query_id, string_agg('[' || pos || '] ' || source || CASE WHEN page IS NULL THEN '' ELSE ' (p.' || page || ')' END || ':' || chr(10) || left(text, CAST(greatest(0, 4500-before) AS BIGINT)), chr(10)||chr(10) ORDER BY pos) AS context, CAST(count(*) AS INTEGER) AS citations
    FROM h WHERE length(left(text, CAST(greatest(0, 4500-before) AS BIGINT))) > 0 GROUP BY 1"""))
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = X.documents(spark, d)
    hits = B.search_documents(docs, asked(spark, d))
    page = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5)
    return B.context_blocks(hits.join(docs.select("doc_id", "source", "text", page.alias("page")), "doc_id"))


@query("u1_corpus_union", "U1", """SELECT kind, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'literature' AS kind, source, text FROM documents
      UNION ALL SELECT 'fact', 'facts', text FROM benchmark UNION ALL SELECT 'note', url, html FROM pages) GROUP BY 1, 2""")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    docs = X.documents(spark, d)
    facts = X.table(spark, d, "benchmark").select(F.lit("facts").alias("source"), "text")
    notes = X.pages(spark, d).select(F.col("url").alias("source"), F.col("html").alias("text"))
    return B.corpus_union(docs, facts, notes).groupBy("kind", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a23_corpus_profile", "A23", sql("posts", "SELECT count(*) AS chunks, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)),4) AS avg_chars, (SELECT count(DISTINCT term) FROM posts) AS vocabulary FROM documents"))
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = X.documents(spark, d)
    out = B.corpus_profile(docs, B.postings(docs))
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("min_chars", "max_chars")}))


@query("t4_top_sources", "T4 A23", "SELECT source, count(*) AS chunks FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return B.top_sources(X.documents(spark, d))
