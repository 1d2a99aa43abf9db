"""BM25 over a document table: postings, inverse frequencies, search, citation blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import text as T
from dustspark.session import is_small

SALTS = 16


@dataclass(frozen=True)
class Index:
    """``postings`` (doc_id, dl, term, tf), ``terms`` (term, df) and ``stats`` (one row: n, avg_len)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def tokenized(docs: DataFrame) -> DataFrame:
    toks = docs.select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return toks.withColumn("dl", F.size("toks"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Document count and mean length in tokens."""
    return tokenized(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_len"))


def _exploded(docs: DataFrame) -> DataFrame:
    # the outer form keeps the optimizer from tokenising once more to skip empty documents
    return tokenized(docs).select("doc_id", "dl", F.explode_outer("toks").alias("term")) \
        .filter(F.col("term").isNotNull())


def postings(docs: DataFrame) -> DataFrame:
    """Term counts per document. Tokens of a document sit in one partition, so they are counted there
    and the exchange carries one row per (document, term)."""
    return (_exploded(docs)
            .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def term_stats(posts: DataFrame) -> DataFrame:
    """Document frequencies. Counted through ``tf``, so that a search which needs the postings as well
    shares their exchange instead of tokenising twice."""
    return posts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def with_idf(terms: DataFrame, stats: DataFrame) -> DataFrame:
    return terms.join(F.broadcast(stats.select("n"))).withColumn("idf", idf(F.col("df"), F.col("n"))).drop("n")


def build_index(docs: DataFrame) -> Index:
    posts = postings(docs)
    return Index(posts, term_stats(posts), corpus_stats(docs))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query with their weight 1 + qtf / (2 * query length)."""
    toks = queries.select("query_id", T.tokens(F.col("query")).alias("toks"))
    exploded = toks.select("query_id", F.size("toks").alias("ql"), F.explode_outer("toks").alias("term")) \
        .filter(F.col("term").isNotNull())
    return exploded.groupBy("query_id", "ql", "term").agg(F.count(F.lit(1)).alias("qtf")).select(
        "query_id", "term", (1.0 + 0.5 * F.col("qtf") / F.col("ql")).alias("q_weight"))


def _match(posts: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """Postings joined with query terms. A few query terms are broadcast; many are joined on the term
    with a salt, so that a term present in every document is spread over many tasks."""
    if few:
        return posts.join(F.broadcast(wanted), "term")
    salted = posts.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, ["term", "_salt"]).drop("_salt")


def bm25(tf: Column, dl: Column, idf_: Column, weight: Column, avg_len: Column,
         k1: float = C.BM25_K1, b: float = C.BM25_B) -> Column:
    return weight * idf_ * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avg_len))


def search(index: Index, queries: DataFrame, k: int = 6, few: bool | None = None) -> DataFrame:
    """Top ``k`` documents of every query: (query_id, doc_id, score, pos), ties in document order.

    ``few`` says whether the query terms may be broadcast; by default they are counted.
    """
    wanted = query_terms(queries)
    few = is_small(wanted) if few is None else few
    scored = _match(index.postings, wanted.join(index.terms, "term"), few).join(F.broadcast(index.stats))
    part = bm25(F.col("tf"), F.col("dl"), idf(F.col("df"), F.col("n")), F.col("q_weight"), F.col("avg_len"))
    totals = scored.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    return top_k(totals.filter(F.col("score") > 0), k)


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """Search without a stored index: only postings of the asked terms are built and shuffled."""
    wanted = query_terms(queries)
    few = is_small(wanted)
    asked = wanted.select("term").distinct()
    exploded = _exploded(docs)
    kept = exploded.join(F.broadcast(asked), "term", "left_semi") if few else exploded
    posts = kept.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return search(Index(posts, term_stats(posts), corpus_stats(docs)), queries, k, few)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows per query. The rank filter is applied before the exchange as well, so a query
    which matches every document ships at most ``k`` rows per task. Scores count as equal up to nine
    decimals, so copies of a document stay in document order whatever the order of summation."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def within_budget(hits: DataFrame, budget: int = C.CONTEXT_BUDGET) -> DataFrame:
    """Texts of the ranked hits until the budget is spent; the last one is cut, later ones drop out."""
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    cut = F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - F.col("_before")).cast("int"))
    return hits.withColumn("_before", before).withColumn("text", cut).filter(F.length("text") > 0).drop("_before")


def context_blocks(hits: DataFrame, budget: int = C.CONTEXT_BUDGET) -> DataFrame:
    """One numbered citation block per query from its at most ``k`` hits (source, page, text)."""
    used = within_budget(hits, budget)
    page = F.when(F.col("page").isNotNull() & (F.col("page") != 0),
                  F.concat(F.lit(" (p."), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    entry = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("source"), page, F.lit(":\n"),
                     F.col("text"))
    return used.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("_e")).select(
        "query_id", F.array_join(F.col("_e.entry"), "\n\n").alias("context"), F.size("_e").alias("citations"))


def chunk_pages(pages: DataFrame, **sizes: int) -> DataFrame:
    """Word-boundary chunks of (source, page, text) rows: adds ``pos`` and replaces ``text``."""
    body = pages.withColumn("_body", T.squeeze_spaces(F.col("text")))
    return body.withColumn("_c", T.word_chunks(F.col("_body"), **sizes)).drop("text", "_body") \
        .select("*", F.inline_outer("_c")).drop("_c").filter(F.col("pos").isNotNull())


def chunk_fixed(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Fixed windows of documents, blank pieces dropped."""
    body = docs.withColumn("_body", T.strip(F.col("text")))
    return body.withColumn("_c", T.fixed_chunks(F.col("_body"), size, overlap)).drop("text", "_body") \
        .select("*", F.inline_outer("_c")).drop("_c").filter(F.col("pos").isNotNull())


def corpus_union(literature: DataFrame, facts: DataFrame, *notes: DataFrame) -> DataFrame:
    """One corpus of (kind, source, url, page, text); absent columns become null."""
    want = "kind string, source string, url string, page int, text string"
    spark = literature.sparkSession
    out = spark.createDataFrame([], want)
    parts = [(literature, "literature"), (facts, "fact"), *[(n, "note") for n in notes]]
    for part, kind in parts:
        shaped = part.withColumn("kind", F.lit(kind))
        keep = [c for c in ("kind", "source", "url", "page", "text") if c in shaped.columns]
        out = out.unionByName(shaped.select(*keep), allowMissingColumns=True)
    return out


def corpus_profile(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """Chunk count, vocabulary size and text lengths, one row."""
    sizes = docs.agg(F.count(F.lit(1)).alias("chunks"), F.min(F.length("text")).alias("min_chars"),
                     F.max(F.length("text")).alias("max_chars"), F.avg(F.length("text")).alias("avg_chars"))
    words = posts.select("term").distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    return sizes.join(F.broadcast(words))


def top_sources(docs: DataFrame, k: int = 20) -> DataFrame:
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "source").limit(k)
