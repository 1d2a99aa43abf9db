"""Text expressions: tokens, chunks, markup stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dustspark import constants as C

_SPACES = r"(?U)\s+"
# Named character references of the page markup
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_FRAGMENT = "\u0001"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, _SPACES, " "))


def squeeze_layout(text: Column) -> Column:
    """Runs of blanks and tabs to one blank, three or more line breaks to two."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def tokens(text: Column) -> Column:
    """Lower-cased tokens without stop words and single characters; duplicates are kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({C.TOKEN_PATTERN})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*C.STOP_WORDS))


def strip_markdown(text: Column) -> Column:
    """Drop link targets and image tags, squeeze blank lines."""
    no_links = F.regexp_replace(text, r"\]\(https?://[^)]+\)", "]")
    no_images = F.regexp_replace(no_links, r"\[Image \d+[^\]]*\]", " ")
    return strip(F.regexp_replace(no_images, r"\n{3,}", "\n\n"))


def html_to_text(html: Column) -> Column:
    """Visible text of a page, one fragment per line."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", _FRAGMENT)
    for tag in ("script", "style", "noscript", "svg"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", _FRAGMENT)
    body = F.regexp_replace(body, r"(?s)<[^>]+>", _FRAGMENT)
    for entity, char in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(char))
    parts = F.filter(F.transform(F.split(body, _FRAGMENT), strip), lambda p: F.length(p) > 0)
    return F.regexp_replace(F.array_join(parts, "\n"), r"\n{3,}", "\n\n")


def fixed_chunks(body: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Array of structs (pos, text): fixed windows over a stripped text column, blank pieces dropped."""
    starts = F.when(F.length(body) > 0,
                    F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(size - overlap)))
    pieces = F.transform(starts, lambda s, i: F.struct(
        i.alias("pos"), strip(F.substring(body, s + 1, F.lit(size))).alias("text")))
    return F.filter(F.coalesce(pieces, F.array().cast("array<struct<pos:int,text:string>>")),
                    lambda p: F.length(p["text"]) > 0)


def word_chunks(body: Column, size: int = 1200, overlap: int = 150, slack: int = 250,
                whole: int = 1400, minimum: int = 60) -> Column:
    """Array of structs (pos, text): windows which end at the last space of their final ``slack``
    characters, the next one starting ``overlap`` before the end. Pages up to ``whole`` stay whole.
    ``body`` is a column which went through ``squeeze_spaces`` already."""
    n = F.length(body)
    # every step advances by at least size - slack - overlap characters
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(n / (size - slack - overlap)).cast("int"), F.lit(0)))
    kind = "struct<start:int,cuts:array<struct<s:int,e:int>>>"
    empty = F.struct(F.lit(0).alias("start"),
                     F.array().cast("array<struct<s:int,e:int>>").alias("cuts")).cast(kind)

    def advance(acc: Column, _: Column) -> Column:
        start = acc["start"]
        end = F.least(start + size, n)
        tail = F.substring(body, start + size - slack + 1, F.lit(slack))
        back = F.instr(F.reverse(tail), " ")
        cut = F.when((end < n) & (back > 0), end - back).otherwise(end)
        following = F.when(cut >= n, F.lit(-1)).otherwise(F.greatest(cut - overlap, start + 1))
        moved = F.struct(following.cast("int").alias("start"),
                         F.concat(acc["cuts"], F.array(F.struct(
                             start.cast("int").alias("s"), cut.cast("int").alias("e")))).alias("cuts"))
        return F.when(start < 0, acc).otherwise(moved.cast(kind))

    cuts = F.when(n <= whole, F.array(F.struct(F.lit(0).alias("s"), n.cast("int").alias("e")))) \
        .otherwise(F.aggregate(steps, empty, advance)["cuts"])
    pieces = F.transform(cuts, lambda c, i: F.struct(
        i.alias("pos"), strip(F.substring(body, c["s"] + 1, c["e"] - c["s"])).alias("text")))
    return F.filter(pieces, lambda p: F.length(p["text"]) >= minimum)
