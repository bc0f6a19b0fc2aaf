"""URLs: canonical form, host, identity keys and tests, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Tracking parameters that the canonical form drops.
TRACKING = r"^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|source|lang)$"
# Locale segments and slug prefixes that identity keys ignore.
LOCALE = r"(?i)^/(?:ko|kr|en|fr|de|ja|jp|zh|cn|es|it|pt|nl)(?:[-_][a-z]{2,4})?(?=/)"
SLUG_LOCALE = r"(?i)^(?:ph|hk|sg|my|id|th|kr|jp|uk|us|au|ca|in)-"
# Entities and their characters in titles; words of a tail that names its site.
TITLE_ENTITIES = ((r"&#8211;|&#8212;|&ndash;|&mdash;", "-"), (r"&#0?38;|&amp;", "&"), (r"&#8217;|&#8216;|&rsquo;|&lsquo;", "'"))
SITE_WORDS = r"magazine|news|times|herald|\.com"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


def is_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(_PARTS) & (part(url, 2) != ""), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host without www. (null if there is none)."""
    return F.when(is_url(url), F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""))


def canonical(url: Column) -> Column:
    """https, lower-case host without www., no fragment or default port, no tracking parameters, sorted ones."""

    def made(u: Column) -> Column:
        name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
        pairs = F.filter(F.split(F.regexp_replace(part(u, 5), r"^\?", ""), "&"), lambda p: (p != "") & ~F.lower(name(p)).rlike(TRACKING))
        # by parameter name, in input order where names are equal
        keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p"))))
        query = text.once(F.array_join(F.transform(keyed, lambda x: x["p"]), "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        port = text.once(part(u, 3), lambda n: F.when(n.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), n)))
        path = text.once(F.regexp_replace(part(u, 4), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
        www = F.regexp_replace(F.lower(part(u, 2)), r"^www\.", "")
        return F.when(is_url(u), F.concat(F.lit("https://"), www, port, path, query)).otherwise(u)

    return text.once(F.trim(url), made)


def history_url(url: Column) -> Column:
    """The canonical form of web addresses, an empty text for all else."""
    return F.when(F.coalesce(F.trim(url).rlike("(?i)^https?://"), F.lit(False)), canonical(url)).otherwise("")


def host_suffixes(h: Column) -> Column:
    """A host and its parent domains: a.b.c -> [a.b.c, b.c]; for subdomain joins as equi-joins."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def without_dots(path: Column) -> Column:
    """A path without . and .. segments (also as %2e); one that ends in such a segment ends in a slash."""
    parts = F.split(path, "/")
    # a segment that is ., .. or neither
    dots = lambda x: F.length(F.regexp_replace(F.regexp_replace(x, "(?i)%2e", "."), r"^(?!\.{1,2}$).*", ""))

    def step(kept: Column, x: Column) -> Column:
        # the first, empty part stands for the root and is never taken away
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(dots(x) == 1, kept).when(dots(x) == 2, up).otherwise(F.concat(kept, F.array(x)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    last = dots(F.element_at(parts, -1)) > 0
    return F.when(path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), F.when(last, F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def absolute(value: Column, base: Column) -> Column:
    """An address as a page at ``base`` means it: whole ones as they are, others after the base's scheme, host or folder.

    Entities are decoded, backslashes of paths are slashes, dot segments are resolved, an empty path is /. Null where the
    value is null or empty, or where neither it nor the base names a host; schemes other than http and https are kept as
    they are.
    """
    v = F.trim(text.decode_numeric(text.decode_entities(value)))
    scheme, host_of = F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), r"^([^/?#]*)"
    web = scheme.isin("http", "https")
    root = F.concat(F.lower(part(base, 1)), F.lit(":"))
    path, query, fragment = F.regexp_extract(v, r"^([^?#]*)", 1), F.regexp_extract(v, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(v, r"(#.*)$", 1)
    path = F.translate(path, "\\", "/")
    after = F.regexp_replace(path, "^[^:/]*:(?=/)", "")  # of whole addresses: what follows the scheme
    whole = F.when(web, after).when((scheme == "") & path.startswith("//"), path)
    authority = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    own = F.regexp_extract(F.regexp_replace(whole, "^/+", ""), host_of, 1)
    own_path = F.regexp_replace(F.regexp_replace(whole, "^/+", ""), host_of, "")
    base_path = F.when(part(base, 4) == "", "/").otherwise(part(base, 4))
    found = (
        F.when(whole.isNotNull(), own_path)
        .when(path.startswith("/"), path)
        .when(path == "", base_path)
        .otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path))
    )
    found = F.when(found == "", "/").otherwise(without_dots(found))
    asked = F.when(whole.isNull() & (path == "") & (query == ""), part(base, 5)).otherwise(query)
    start = F.when(web, F.concat(scheme, F.lit(":"))).otherwise(root)
    at = F.lower(F.when(whole.isNotNull(), own).otherwise(authority))
    made = F.concat(start, F.lit("//"), at, found, asked, fragment)
    usable = F.when(whole.isNotNull(), (own != "") & (web | is_url(base))).otherwise(is_url(base))
    return F.when(F.coalesce(v, F.lit("")) == "", None).when((scheme != "") & ~web, v).when(usable, made)


def decoded(path: Column) -> Column:
    """Percent-encoded UTF-8 as text; a path with an escape that is none, or whose bytes are no UTF-8, as it is."""

    def plain(p: Column) -> Column:
        lost = lambda out: F.coalesce(out.contains("\ufffd") & ~p.rlike("(?i)%EF%BF%BD|\ufffd"), F.lit(True))
        read = text.once(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), lambda out: F.when(lost(out), p).otherwise(out))
        return F.when(~p.contains("%") | p.rlike("%(?![0-9A-Fa-f]{2})"), p).otherwise(read)

    return text.once(path, plain)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 4), "/"), lambda p: p != "")


def normal_title(title: Column, h: Column) -> Column:
    """Lower-case letters and digits of an original title, without a tail that names its site."""
    t = F.lower(F.coalesce(title, F.lit("")))
    for pattern, by in TITLE_ENTITIES:
        t = F.regexp_replace(t, pattern, by)
    site = F.element_at(F.split(h, r"\."), 1)
    tail = lambda x: F.regexp_extract(x, r"(?U)(\s+[-–—|]\s+[^-–—|]{2,40})$", 1)
    named = lambda e: (e != "") & (e.contains(site) | e.rlike(SITE_WORDS))
    t = text.once(t, lambda x: text.once(tail(x), lambda e: F.when(named(e), F.left(x, F.length(x) - F.length(e))).otherwise(x)))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "['’‘\"“”`]", ""), r"[^\p{L}\p{N}]+", " "))


def identity_keys(url: Column, title: Column, second: Column | None = None, source: Column | None = None) -> Column:
    """Keys of which any shared one says two rows are the same reference: u: address, p: path, s: slug, t: title.

    A second address (of an aggregator) gives a key u: of its own; rows whose address names no host have their titles
    compared within their source's name. Paths are compared with their percent-encoded text decoded. Each step is
    computed once a row: written into the next, the address would be taken apart hundreds of times.
    """
    named = F.lit("") if source is None else F.lower(F.coalesce(source, F.lit("")))
    other = F.lit(None).cast("string") if second is None else text.once(second, lambda x: F.when(x != "", F.concat(F.lit("u:"), canonical(x))))
    size = lambda x, by: F.size(F.split(x, by))

    def placed(a: Column) -> Column:
        """Host, path without its locale, query of a canonical address, and whether there is a path."""
        h = F.when(a["web"], F.regexp_replace(F.lower(part(a["u"], 2)), r"^(?:www\d?|m|amp)\.", "")).otherwise(named)
        path = F.regexp_replace(F.regexp_replace(F.lower(decoded(part(a["u"], 4))), r"/amp/?$", "/"), "/+$", "")
        bare = text.once(path, lambda p: F.struct(F.regexp_replace(p, LOCALE, "").alias("bare"), (a["web"] & (p != "")).alias("own")))
        return text.once(bare, lambda b: F.struct(h.alias("h"), b["bare"].alias("bare"), b["own"].alias("own"), part(a["u"], 5).alias("search")))

    def keys(x: Column, u: Column, p: Column) -> Column:
        last = F.regexp_replace(F.regexp_extract(p["bare"], "([^/]*)$", 1), r"\.(?:html?|php|aspx?)$", "")
        slugs = lambda s: (p["search"] == "") & (F.length(s) >= 24) & (size(s, "-") >= 4) & ~s.rlike(r"^\d+$")
        slug = text.once(F.regexp_replace(last, SLUG_LOCALE, ""), lambda s: F.when(p["own"] & slugs(s), F.concat(F.lit("s:"), p["h"], F.lit("/"), s)))
        words = text.once(normal_title(title, p["h"]), lambda w: F.when((F.length(w) >= 24) & (size(w, " ") >= 4), F.concat(F.lit("t:"), p["h"], F.lit("|"), w)))
        address = F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("u:"), u))
        return F.array(address, other, F.when(p["own"], F.concat(F.lit("p:"), p["h"], p["bare"], p["search"])), slug, words)

    def made(x: Column) -> Column:
        known = F.struct(canonical(x).alias("u"), is_url(x).alias("web"))
        return text.once(known, lambda a: text.once(placed(a), lambda p: keys(x, a["u"], p)))

    return F.array_distinct(F.array_compact(text.once(url, made)))


def title_from_slug(url: Column) -> Column:
    """Last path segment as words."""
    last = F.coalesce(F.element_at(F.filter(F.split(part(url, 4), "/"), lambda p: p != ""), -1), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]{2,5}$", ""), "[-_]+", " "))


def kind(url: Column) -> Column:
    """video, image or web."""
    return (
        F.when(F.lower(url).rlike(r"youtube\.com|youtu\.be|vimeo\.com|\.(?:mp4|webm|mov)(?:$|[?#])"), "video")
        .when(F.lower(url).rlike(r"pinterest\.|instagram\.|\.(?:jpe?g|png|gif|webp)(?:$|[?#])"), "image")
        .otherwise("web")
    )


def is_source_level(url: Column) -> Column:
    """At most one path segment and no query: the address of a source rather than of an article."""
    return is_url(url) & (F.size(path_segments(url)) <= 1) & (part(url, 5) == "")


def is_usable(url: Column) -> Column:
    """A web address that is neither a search nor an account page."""
    return F.coalesce(F.lower(url).rlike("^https?://") & ~F.lower(url).rlike(r"/(?:login|signin|signup|auth|oauth|account|checkout)(?:[/?#]|$)|[?&](?:q|s|query|search)=|/search(?:[/?#]|$)"), F.lit(False))
