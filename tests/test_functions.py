"""Numeric anchors and edge rules of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from dustspark.functions import cleaning as CL
from dustspark.functions import physics as P
from dustspark.functions import scoring as SG
from dustspark.functions import soiling as S
from dustspark.functions import text as T


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit(*values):
    return [F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in values]


def test_anchors(spark):
    rate = P.deposit_rate(*lit(700, 300, 10, 0))
    dsc = F.lit(30.0)
    r, day, month, y = one(spark, rate, P.optical_loss_pct(rate), P.optical_loss_pct(dsc * rate),
                           P.specific_yield(*lit(22, 30, 15)))
    assert 0.05 <= r <= 1.0
    assert 0.05 <= day <= 1.0
    assert 10 <= month <= 35
    assert 3.0 <= y <= 6.5


def test_numeric_sanitiser(spark):
    rows = ["", "None", "nan", "inf", "-inf", " 12.5 ", "1e3", "abc", None]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = [r[0] for r in df.select(CL.num("v", -1.0)).collect()]
    assert got == [-1, -1, -1, -1, -1, 12.5, 1000.0, -1, -1]


def test_dust_factor_counts_zero_as_missing(spark):
    bias = F.lit(1.0)
    zero = S.dust_factor(*lit(120, None, 0, 0, 0, 6), bias)
    missing = S.dust_factor(*lit(120, None, None, None, None, None), bias)
    a, b = one(spark, zero, missing)
    assert a == pytest.approx(b)
    dust_only, neither = one(spark, S.dust_factor(*lit(None, 240, 3, 3, 30, 6), bias),
                             S.dust_factor(*lit(None, None, 3, 3, 30, 6), bias))
    assert dust_only == pytest.approx(2 * neither)


def test_loss_is_capped(spark):
    low, high = one(spark, S.loss_pct(*lit(0, 0.9, 180)), S.loss_pct(*lit(4000, 0.9, 180)))
    assert low == 0.0 and high == pytest.approx(55.0)


def test_risk_labels(spark):
    score = S.weather_risk_score(*lit(14, 250, 0.8)) + S.loss_risk_score(F.lit(25.0))
    assert one(spark, S.risk_label(score), S.risk_label(S.weather_risk_score(*lit(None, None, None)))) == ("severe", "low")


def test_storm_level_steps(spark):
    levels = one(spark, *[SG.storm_level(F.lit(p), F.lit(0.3)) for p in (0.5, 0.3, 0.18, 0.17)])
    assert levels == ("storm likely", "watch", "watch", "quiet")


def test_batch_economics(spark):
    e = SG.batch_economics(F.lit(5.0), F.lit(10.0))
    row = spark.range(1).select(*[c.alias(k) for k, c in e.items()]).first()
    break_even = 1.0 / (5.5 * 0.18 * 7) * 100
    assert row["break_even_pct"] == pytest.approx(break_even)
    assert row["days_until_clean"] == math.ceil((break_even - 5.0) / 0.5)


def test_tokens_keep_duplicates_and_drop_stop_words(spark):
    assert one(spark, T.tokens(F.lit("The PM10 of PM10, pm2_5 a x 45% dry-wet")))[0] == ["pm10", "pm10", "pm2_5", "45%", "dry-wet"]


def test_html_to_text(spark):
    page = "<p>A &amp;lt; b</p><script>x<y</script><!-- no --><svg><text>z</text></svg><b> c\n </b>"
    assert one(spark, T.html_to_text(F.lit(page)))[0] == "A &lt; b\nc"


def _word_chunks(text, size=1200, overlap=150, slack=250, whole=1400, minimum=60):
    body = " ".join(text.split())
    if len(body) <= whole:
        return [body] if len(body) >= minimum else []
    out, start = [], 0
    while True:
        end = min(start + size, len(body))
        if end < len(body):
            cut = body.rfind(" ", start + size - slack, end)
            end = cut if cut > start else end
        out.append(body[start:end].strip())
        if end >= len(body):
            return [p for p in out if len(p) >= minimum]
        start = max(end - overlap, start + 1)


@pytest.mark.parametrize("text", [
    "", "short", "word " * 100, "word " * 281, "word " * 3000, "x" * 5000, ("é" * 7 + " ") * 900,
    "a" * 1190 + " " + "b" * 3000, ("line\n\n\tmore " * 700), "tail " * 239 + "z" * 400])
def test_word_chunks_match_a_loop(spark, text):
    from dustspark.operators.retrieval import chunk_pages
    df = spark.createDataFrame([("d", text)], "source string, text string")
    got = [r["text"] for r in chunk_pages(df).orderBy("pos").collect()]
    assert got == _word_chunks(text)


def test_fixed_chunks_cover_the_whole_text(spark):
    from dustspark.operators.retrieval import chunk_fixed
    text = "".join(chr(97 + i % 26) for i in range(5000))
    df = spark.createDataFrame([("d", text)], "source string, text string")
    got = [r["text"] for r in chunk_fixed(df).orderBy("pos").collect()]
    assert got == [text[i:i + 1200] for i in range(0, 5000, 1050)]
