"""Toxicity: a linear-chain conditional random field over tokens with the labels clean (0) and toxic (1).

Labels exist for documents only, so the tokens are labelled from them: over all labelled training rows the document
frequencies of words and word beginnings in toxic and in clean documents are counted; a token of a toxic document is labelled
toxic if one of its features is frequent enough there and many times rarer in clean ones. The field (features: word, its first
four and five letters; and the transitions) is fitted by gradient steps on a bounded sample of labelled rows (SAMPLE per class,
by hash). Forward and backward messages of two labels are log odds, one number each, so that a step is the same arithmetic over
all documents of a batch; their sum is a token's marginal. The sum and the maximum of the marginals of a document give its
score through a logistic fit on the same sample. Tokens with a marginal of at least one half are the offending spans.

Held out: rows whose crc32 of the id (as text) is divisible by 5; nothing is learned from them. A null id has crc32 of ''.
Texts that are null or without a token have no marginals and get the score of a document with sum and maximum 0. With no
labelled training rows, or with one class only, every score is the share of toxic ones (0 without rows). Rows are scored alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import ship

TOKEN = re.compile(r"\w+")
FOLDS = 5
SAMPLE = 1000
LEAST_CONTEXTS = 5
ODDS = 20.0
MOST_FEATURES = 200_000
STEPS = 30
RATE = 0.3
L2 = 1e-6
MEMO = 300_000
BATCH_TOKENS = 1 << 20
#: size of the filter of labelled ids: at most 2048 rows of 4 KB are broadcast, whatever the number of labels
FILTER_BITS = 1 << 26


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def features(token: str) -> tuple[str, ...]:
    t = token.lower()
    return ("w" + t, "4" + t[:4], "5" + t[:5]) if len(t) > 5 else ("w" + t,)


@dataclass
class Field:
    """Fitted parameters: feature weights, transitions (from, to) against clean-clean, and the document logistic."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)  # clean-toxic, toxic-clean, toxic-toxic
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)  # constant, log(1 + sum), maximum


def _forward(x: np.ndarray, moves: tuple[float, float, float]) -> np.ndarray:
    """log odds of (clean, toxic) at a step from those at the step before"""
    to, back, stay = moves
    return np.logaddexp(to, x + stay) - np.logaddexp(0.0, x + back)


def _backward(x: np.ndarray, moves: tuple[float, float, float]) -> np.ndarray:
    to, back, stay = moves
    return np.logaddexp(back, x + stay) - np.logaddexp(0.0, x + to)


def messages(emit: np.ndarray, lengths: np.ndarray, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of every token; ``emit`` holds the documents one after another."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    f, b = emit.copy(), np.zeros_like(emit)
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for t in range(1, len(active)):
        i = at[:active[t]] + t
        f[i] += _forward(f[i - 1], moves)
        j = at[:active[t]] + size[:active[t]] - 1 - t
        b[j] = _backward(emit[j + 1] + b[j + 1], moves)
    return f, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_field(texts: list[str], toxic: np.ndarray, suspects: set[str]) -> Field:
    """Fits the field on the tokens of a bounded sample, then the logistic on its documents."""
    tokens = [TOKEN.findall(t or "") for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    index: dict[str, int] = {}
    per_word: dict[str, tuple[list[int], bool]] = {}
    rows: list[int] = []
    cols: list[int] = []
    y = np.zeros(int(lengths.sum()))
    k = 0
    for doc, label in zip(tokens, toxic, strict=True):
        for w in doc:
            known = per_word.get(w)
            if known is None:
                fs = features(w)
                ids = [index.setdefault(x, len(index)) for x in fs] if len(index) < MOST_FEATURES else [index[x] for x in fs if x in index]
                known = per_word[w] = (ids, any(x in suspects for x in fs))
            rows.extend([k] * len(known[0]))
            cols.extend(known[0])
            y[k] = label and known[1]
            k += 1
    r, c = np.array(rows, np.int64), np.array(cols, np.int64)
    w, bias, moves = np.zeros(len(index)), -3.0, np.zeros(3)
    sq_w, sq_b, sq_m = np.full(len(index), 1e-8), 1e-8, np.full(3, 1e-8)
    first = np.zeros(k, bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    inner = np.flatnonzero(~first)
    pair = np.array([((1 - y[inner - 1]) * y[inner]).sum(), (y[inner - 1] * (1 - y[inner])).sum(), (y[inner - 1] * y[inner]).sum()])
    for _ in range(STEPS):
        emit = np.bincount(r, w[c], k) + bias
        f, b = messages(emit, lengths, tuple(moves))
        gap = y - _sigmoid(f + b)
        g_w = np.bincount(c, gap[r], len(index)) - L2 * w
        g_b = gap.sum()
        left, right = f[inner - 1], emit[inner] + b[inner]
        scores = np.array([np.zeros(len(inner)), right + moves[0], left + moves[1], left + right + moves[2]])
        scores = np.exp(scores - scores.max(0))
        g_m = pair - (scores[1:] / scores.sum(0)).sum(1)
        sq_w += g_w * g_w
        sq_b += g_b * g_b
        sq_m += g_m * g_m
        w += RATE * g_w / np.sqrt(sq_w)
        bias += RATE * g_b / np.sqrt(sq_b)
        moves += RATE * g_m / np.sqrt(sq_m)
    f, b = messages(np.bincount(r, w[c], k) + bias, lengths, tuple(moves))
    model = Field({x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-3}, float(bias), tuple(map(float, moves)))
    x = np.array([_summary(_sigmoid(m)) for m in np.split(f + b, np.cumsum(lengths)[:-1])])
    x = np.c_[np.ones(len(x)), x]
    v, t = np.zeros(3), np.asarray(toxic, float)
    for _ in range(50):  # Newton steps with a ridge
        p = _sigmoid(x @ v)
        v += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (t - p) - 1e-2 * v)
    model.logistic = tuple(map(float, v))
    return model


def _summary(marginals: np.ndarray) -> tuple[float, float]:
    return (float(np.log1p(marginals.sum())), float(marginals.max())) if len(marginals) else (0.0, 0.0)


def _kinds(word: Column) -> Column:
    """The features of a lower-case word, as an expression."""
    long = F.array(F.concat(F.lit("w"), word), F.concat(F.lit("4"), F.substring(word, 1, 4)), F.concat(F.lit("5"), F.substring(word, 1, 5)))
    return F.when(F.length(word) > 5, long).otherwise(F.array(F.concat(F.lit("w"), word)))


def suspects(labelled: DataFrame) -> DataFrame:
    """Features of toxic documents: before at least LEAST_CONTEXTS different words there, and in ODDS times the share of documents
    that they have among clean ones. All rows are counted. Words that only copies of one text repeat have one context."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    rows = labelled.select("toxic", words.alias("words"))
    pairs = F.transform("words", lambda w, i: F.struct(_kinds(w).alias("features"), F.get(F.col("words"), i + 1).alias("next")))
    # 32 bits tell the few next words of one feature apart; the number stands before the word so that rows compress in the shuffle
    met = rows.where("toxic = 1").select(F.explode(pairs).alias("x")).select(F.hash("x.next").alias("next"), F.explode("x.features").alias("feature"))
    varied = met.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    n = labelled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    seen = rows.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct("words"), _kinds)))).alias("feature"))
    counts = seen.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad > 0")
    rate = F.col("bad") / F.lit(float(n["bad"] or 1)) / ((F.col("good") + 2) / F.lit(float(n["good"] or 1)))
    return counts.where(rate >= ODDS).join(varied, "feature")


def maybe_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose hashed id is among the hashed labelled ids. None that is labelled is lost; some others stay, all of them
    once the labels are many more than the bits, so the exact join follows."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FILTER_BITS)) + 1
    bits = known.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return docs.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("_part")).where(hit).select(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field from labelled rows that are not held out. The sample and the suspects that reach the driver are bounded."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # held-out texts and most that have no label stay out of the shuffle; the hint keeps the plan alike at every size
    rows = maybe_labelled(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), known).join(known.hint("merge"), "doc_id")
    share = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    if not share["n"] or share["bad"] in (0, share["n"]):
        p = min(max((share["bad"] or 0) / max(share["n"], 1), 1e-6), 1 - 1e-6)
        return Field(logistic=(float(np.log(p / (1 - p))), 0.0, 0.0))
    rare = suspects(rows).orderBy(F.desc("contexts"), "feature").limit(MOST_FEATURES).select("feature")
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    picked = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id").toPandas()
    return fit_field(sample["text"].tolist(), sample["toxic"].to_numpy(), {r["feature"] for r in rare.toLocalIterator()})


def scorer(model: Field):
    """A column function: text -> (score, spans)."""
    memo: dict[str, float] = {}

    def emission(w: str) -> float:
        if len(memo) > MEMO:
            memo.clear()
        e = memo[w] = model.bias + sum(model.weights.get(x, 0.0) for x in features(w))
        return e

    def run(texts: list[str | None]) -> list[tuple[float, str]]:
        found = [TOKEN.findall(t or "") for t in texts]
        lengths = np.array([len(t) for t in found], np.int64)
        emit = np.empty(int(lengths.sum()))
        k = 0
        for ws in found:
            got = list(map(memo.get, ws))
            if None in got:
                got = [emission(w) if g is None else g for w, g in zip(ws, got, strict=True)]
            emit[k:k + len(ws)] = got
            k += len(ws)
        f, b = messages(emit, lengths, model.moves)
        p = _sigmoid(f + b)
        out = []
        k = 0
        for t, n in zip(texts, lengths.tolist(), strict=True):
            m = p[k:k + n]
            k += n
            s, most = _summary(m)
            c = model.logistic
            score = float(_sigmoid(np.float64(c[0] + c[1] * s + c[2] * most)))
            spans = ""
            if most >= 0.5:
                spans = ",".join(f"{x.start()}:{x.end()}" for x, bad in zip(TOKEN.finditer(t), m >= 0.5, strict=True) if bad)
            out.append((score, spans))
        return out

    @F.pandas_udf("score double, spans string")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple[float, str]] = []
        held: list[str | None] = []
        chars = 0
        for t in texts:
            held.append(t)
            chars += len(t or "")
            if chars > 5 * BATCH_TOKENS:
                rows += run(held)
                held, chars = [], 0
        rows += run(held) if held else []
        return pd.DataFrame(rows, columns=["score", "spans"])
    return score


def score(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", scorer(model)(F.col("text")).alias("s"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score", F.when(F.col("s.score") >= 0.5, 1).otherwise(0).alias("predicted"), "s.spans")
