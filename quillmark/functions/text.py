"""Texts: entities, markup, tokens, titles and snippets, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tails that a title key drops.
PUBLISHER_TAIL = r"(?iu)\s*[-–—|]\s*(?:frieze|프리즈|dezeen|designboom|vogue|코리아타임스|the korea times|koreaherald\.com|frieze\.com)\s*$"
# The five entities that page texts decode.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
# Words of paragraphs that are not content.
BOILERPLATE = "cookie|subscribe|newsletter|sign up|all rights reserved|privacy policy|advertisement"
SPACE = r"[\s ﻿]+"
# The same runs but single plain spaces, which stay as they are; texts are mostly those.
_OTHER_SPACE = rf"(?!\x20){SPACE}|\x20{SPACE}"


def once(x: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def decode_entities(text: Column) -> Column:
    """Five named entities, in order; runs of white space become one space."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, _OTHER_SPACE, " "))


def decode_numeric(text: Column) -> Column:
    """Numeric entities, decimal and hexadecimal, each decoded once; those of no character stay as they are."""
    found = r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"

    def char(code: Column) -> Column:
        point = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        real = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), code, F.lit(";")))

    codes = F.regexp_extract_all(text, F.lit(found), F.lit(1))
    joined = F.array_join(F.zip_with(F.split(text, found), F.transform(codes, char), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("&#"), joined).otherwise(text)


def strip_html(html: Column) -> Column:
    """The text of a page: no scripts, styles or tags, entities decoded."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, f"(?is)<{tag}.*?</{tag}>", " ")
    return decode_entities(F.regexp_replace(html, "<[^>]+>", " "))


def first_match(html: Column, pattern: str) -> Column:
    return decode_entities(F.regexp_extract(html, pattern, 1))


def page_title(html: Column) -> Column:
    named = first_match(html, r"(?is)<title[^>]*>(.*?)</title>")
    shared = first_match(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""")
    some = lambda t: once(t, lambda x: F.nullif(x, F.lit("")))
    return F.coalesce(some(named), some(shared))


def meta_content(html: Column, name: str) -> Column:
    """Content of a meta tag, whichever attribute comes first."""
    forth = F.regexp_extract(html, rf"""(?i)<meta[^>]+(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    back = F.regexp_extract(html, rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]*(?:property|name)=["']{name}["']""", 1)
    return decode_entities(F.coalesce(F.nullif(forth, F.lit("")), F.nullif(back, F.lit("")), F.lit("")))


def distinct_matches(html: Column, pattern: str, most: int) -> Column:
    """The first so many distinct matches of group 1."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), 1, most)


def paragraphs(html: Column, least: int = 45) -> Column:
    """Distinct texts of paragraphs, headings, quotes and list items, without boilerplate, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(p|h2|h3|blockquote|li)\b[^>]*>(.*?)</\1>"), F.lit(2))
    texts = F.filter(F.transform(found, strip_html), lambda t: (F.length(t) >= least) & ~F.lower(t).rlike(BOILERPLATE))
    return F.array_distinct(texts)


def harvest(html: Column, least: int = 400) -> Column:
    """Paragraphs of the article, else of main, else of the page: the first scope with enough text."""
    out = F.lit("")
    for scope in (html, F.regexp_extract(html, r"(?is)(<main\b.*?</main>)", 1), F.regexp_extract(html, r"(?is)(<article\b.*?</article>)", 1)):
        joined = F.array_join(paragraphs(scope), "\n")
        out = F.when(F.length(joined) >= least, joined).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Runs of two or more letters or digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))


def query_tokens(text: Column) -> Column:
    """Lower-case tokens of two or more characters; hyphens stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " "), r"\s+"), lambda t: F.length(t) > 1)


def title_key(title: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), PUBLISHER_TAIL, "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def title_tokens(title: Column, stop_words: Column, years: bool = False) -> Column:
    """Distinct tokens of a title, without stop words and, unless they are asked for, without years."""
    t = F.lower(F.coalesce(title, F.lit("")))
    if not years:
        t = F.regexp_replace(t, r"(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}(?![A-Za-z0-9_])", " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1)), lambda w: ~F.array_contains(stop_words, w)))


def overlap(a: Column, b: Column, least: int = 3) -> Column:
    """Overlap coefficient of two token sets; 0 if they share too few."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((shared < least) | (F.least(F.size(a), F.size(b)) == 0), F.lit(0.0)).otherwise(shared / F.least(F.size(a), F.size(b)))


def snippet(text: Column, terms: list[str], before: int = 90, size: int = 260) -> Column:
    """A stretch around the earliest term, with dots where it is cut."""
    low = F.lower(text)
    hits = F.filter(F.array(*[F.locate(t.lower(), low) for t in terms]), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(hits), F.lit(1)) - 1 - before)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, F.lit(size)), F.when(start + size < F.length(text), "...").otherwise(""))


def compact(text: Column, most: int) -> Column:
    """Without a publisher tail, cut to so many characters with dots."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+[-–—|]\s+[^-–—|]{2,40}$", ""), SPACE, " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 3))), F.lit("..."))).otherwise(t)


def has_term(text: Column, term: str) -> Column:
    """Whole-word test for single words of a-z and 0-9, containment for all other terms."""
    if term.isascii() and term.isalnum() and term == term.lower():
        return F.lower(text).rlike(rf"(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])")
    return F.lower(text).contains(term)


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in a text (containment)."""
    out = F.lit(0)
    for t in terms:
        out = out + F.lower(text).contains(t).cast("int")
    return out


# Sentences that publishing systems append to feed summaries.
FEED_TAILS = (
    r"(?i)The post .{0,200}? appeared first on .{0,80}?\.?$",
    r".{0,120}\| .{0,60} 에 처음 등장했습니다\.?",
    r".{0,80}에 처음 등장했습니다\.?",
    r"(?i)appeared first on [^.]{0,80}\.?",
    r"\[(?:Watch|Read more|Read More|자세히 읽기|더 읽기|보기|…|\.\.\.)\]",
    r"(?i)\s*(?:Continue reading|Read more)\s*(?:\.{3}|…)?\s*$",
)


# Every match of a tail holds one of these (in lower case) or a bracket with one of those; the two Korean
# tails hold the second.
_TAIL_SIGNS, _BRACKETS = ("appeared first on", "에 처음 등장했습니다", "continue reading", "read more"), r"(?i)\[(?:watch|자세히|더|보기|…|\.)"
_KOREAN_TAIL = "에 처음 등장했습니다"


def clean_feed(text: Column, most: int | None = None) -> Column:
    """A feed summary without the sentences that publishing systems append; its first so many characters.

    Tails begin with open stretches, which are tried at every character, so texts without the fixed part of a tail are
    told by plain scans and left as they are. Where only the beginning is asked for, white space of the beginning is
    reduced first, and that of the whole text only if this leaves too little.
    """

    def without(t: Column, patterns: tuple[str, ...]) -> Column:
        for pattern in patterns:
            t = F.regexp_replace(t, pattern, "")
        return t

    def tails(t: Column) -> Column:
        t = once(without(t, FEED_TAILS[:1]), lambda u: F.when(u.contains(_KOREAN_TAIL), without(u, FEED_TAILS[1:3])).otherwise(u))
        return without(t, FEED_TAILS[3:])

    def signed(t: Column) -> Column:
        found = once(F.lower(t), lambda low: reduce(Column.__or__, [low.contains(x) for x in _TAIL_SIGNS]))
        return found | t.contains("[") & t.rlike(_BRACKETS)

    spaced = lambda t: F.trim(F.regexp_replace(t, _OTHER_SPACE, " "))
    text = once(text, lambda t: F.when(signed(t), tails(t)).otherwise(t))
    if most is None:
        return spaced(text)
    enough = lambda t, start: F.when(F.length(start) >= most, start).otherwise(spaced(t))
    return F.left(once(text, lambda t: once(spaced(F.left(t, F.lit(4 * most))), lambda start: enough(t, start))), F.lit(most))


def loose_json(text: Column, schema: str) -> Column:
    """The widest bracketed span of a text, read with a schema."""
    return F.from_json(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), schema)


def same_meaning(a: Column, b: Column) -> Column:
    """Equal or one inside the other, letters and digits only."""
    x, y = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "") for c in (a, b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def hits_exact(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in a text, as they are written."""
    out = F.lit(0)
    for t in terms:
        out = out + text.contains(t).cast("int")
    return out
