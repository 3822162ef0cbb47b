"""Column functions over HTML: picks from the page, embedded business data, page classes.

There is no parser here: scripts, styles and comments are taken out first, then regular expressions pick what is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions import contacts, urls
from leadweave.functions.text import or_empty, strip_tags

# Types of embedded data that describe a business.
BUSINESS_TYPES = ("localbusiness", "organization", "store", "restaurant", "industrialorganization", "corporation", "educationalorganization", "medicalbusiness", "pharmacy", "healthandsafetybusiness")
# Shortest page and telling phrases of login walls.
LOGIN_WALLS = {
    "social": (1500, ("log in to facebook", "log into facebook", "log in to instagram", "sign up for tiktok", "you must log in", "please log in", "captcha", "are you a robot")),
    "facebook": (2000, ("log in to facebook", "you must log in", "sign up for facebook", "captcha-block")),
    "instagram": (1500, ("log into instagram", "sign up for instagram", "you must be 18", "captcha")),
    "tiktok": (1500, ("log in to tiktok", "sign up for tiktok", "are you a robot", "captcha")),
}
# Status codes, smallest body and phrases of block pages; the first phrase in this order wins.
BLOCK_CODES = (401, 403, 429, 503)
SMALLEST_BODY = 200
BLOCK_PHRASES = (
    r"captcha", r"robot\s*check", r"security\s*check", r"cloudflare", r"cf-browser-verification", r"ip\s*blocked", r"access\s*denied",
    r"rate\s*limit\s*exceeded", r"request\s*blocked", r"please\s*verify\s*you\s*are\s*a\s*human", r"_dd_s\b", r"datadome",
)
# What RE2 takes for white space, what DuckDB's trim() takes off, and comments, scripts and styles as RE2 reads them: a long s is an s, only ASCII letters and digits end a word.
SQL_SPACE = r"[\t\n\f\r ]"
SQL_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SQL_CODE = rf"(?is)<!--.*?-->|<[sſ]cript(?!\w)[^>]*>.*?</[sſ]cript{SQL_SPACE}*>|<[sſ]tyle(?!\w)[^>]*>.*?</[sſ]tyle{SQL_SPACE}*>"
PROFILE = "struct<name:string,address:string,phones:array<string>,email:string,socials:array<string>,rating:double,reviews:int>"


def body(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(or_empty(html), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " ")


def _inner(html: Column, tag: str) -> Column:
    return strip_tags(F.regexp_extract(body(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def title(html: Column) -> Column:
    return _inner(html, "title")


def heading(html: Column) -> Column:
    return _inner(html, "h1")


def visible_text(html: Column) -> Column:
    """Text between tags, a space for each tag."""
    return strip_tags(F.regexp_replace(body(html), "<[^>]+>", " "))


def written_title(html: Column) -> Column:
    """The title as the page has it, by the rule of page_titles' SQL: tags and entities stay, but for ``&amp;``; null: no page.

    If the first opening tag has no end, no later one has."""
    found = F.regexp_extract(F.regexp_replace(html, SQL_CODE, " "), rf"(?is)\A(?>.*?<title(?!\w))[^>]*+>(.*?)</title{SQL_SPACE}*+>", 1)
    return F.replace(F.btrim(F.regexp_replace(found, f"{SQL_SPACE}+", " "), F.lit(SQL_BLANKS)), F.lit("&amp;"), F.lit("&"))


def link_count(html: Column) -> Column:
    """Number of anchors that have ``href`` in them, by the rule of page_titles' SQL; null: no page."""
    tags = F.regexp_extract_all(F.regexp_replace(html, SQL_CODE, " "), F.lit(r"(?i)<a(?!\w)[^>]*+(?:>|\z)"), F.lit(0))
    return F.array_size(F.filter(tags, lambda a: a.endswith(">") & a.rlike("(?i)href")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag: double-quoted, single-quoted or bare."""
    found = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
    return F.when(found[0] != "", found[0]).when(found[1] != "", found[1]).otherwise(found[2])


def hrefs(html: Column) -> Column:
    """Targets of all anchors in order."""
    return F.filter(F.transform(F.regexp_extract_all(body(html), F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)), lambda a: attribute(a, "href")), lambda h: h != "")


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of all anchors with a target, in order."""
    found = F.regexp_extract_all(body(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    made = F.transform(found, lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), "href").alias("href"), strip_tags(a).alias("text")))
    return F.filter(made, lambda x: x["href"] != "")


def meta(html: Column, key: str) -> Column:
    """Content of the first meta tag with this name or property, in either order of its attributes; none: empty."""
    tag = F.regexp_extract(or_empty(html), rf"(?is)<meta\b[^>]*(?:property|name)\s*=\s*[\"']{key}[\"'][^>]*>", 0)
    return F.trim(attribute(tag, "content"))


def og_name(html: Column, kind: str = "social") -> Column:
    """The shared title, else the page's title without the platform's suffix."""
    t = title(html)
    cut = {
        "social": F.regexp_extract(t, r"^(.*?)(?:\s*[|\-–]\s*.*)?$", 1),
        "facebook": F.substring_index(F.substring_index(t, " - ", 1), " | ", 1),
        "instagram": F.substring_index(F.substring_index(t, " • ", 1), " - ", 1),
        "tiktok": t,
    }[kind]
    og = meta(html, "og:title")
    return F.when(og != "", og).otherwise(F.trim(cut))


def is_login_wall(html: Column, kind: str = "social") -> Column:
    floor, phrases = LOGIN_WALLS[kind]
    low = F.lower(or_empty(html))
    return (F.length(or_empty(html)) < floor) | reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def block_class(status: Column, content_type: Column, html: Column) -> Column:
    """``http:N``, ``body:too_small``, ``content-type:X`` or ``signature:match``, the first that applies; null: a normal page."""
    size, kind = F.octet_length(or_empty(html)), F.lower(or_empty(content_type))
    hits = []
    for p in BLOCK_PHRASES:
        hit = F.lower(F.regexp_extract(or_empty(html), f"(?i){p}", 0))
        hits.append(F.when(hit != "", F.concat(F.lit("signature:"), hit)))
    return F.coalesce(
        F.when(status.isin(*BLOCK_CODES), F.concat(F.lit("http:"), status.cast("string"))),
        F.when((size > 0) & (size < SMALLEST_BODY), F.lit("body:too_small")),
        F.when((kind != "") & ~kind.contains("text/html") & ~kind.contains("application/json"), F.concat(F.lit("content-type:"), F.substring_index(kind, ";", 1))),
        *hits,
    )






def json_ld(html: Column, list_types: bool = False) -> Column:
    """The first business among the page's JSON-LD blocks, as a variant: a block, an item of a list, or of its ``@graph``.

    Blocks that are not JSON are skipped. A list of types counts only with ``list_types``."""
    blocks = F.regexp_extract_all(or_empty(html), F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1))
    asked = lambda n: F.lower(F.try_variant_get(n, '$["@type"]', "string")).isin(*BUSINESS_TYPES) | (F.exists(F.coalesce(F.try_variant_get(n, '$["@type"]', "array<string>"), F.array().cast("array<string>")), lambda t: F.lower(t).isin(*BUSINESS_TYPES)) if list_types else F.lit(False))

    def nodes(block: Column) -> Column:
        v = F.try_parse_json(F.trim(block))
        none = F.array().cast("array<variant>")
        top = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), none)
        graph = lambda n: F.coalesce(F.try_variant_get(n, '$["@graph"]', "array<variant>"), none)
        return F.flatten(F.transform(top, lambda n: F.concat(F.array(n), graph(n))))

    found = F.flatten(F.transform(blocks, nodes))
    return F.get(F.filter(found, lambda n: F.coalesce(asked(n), F.lit(False))), F.lit(0))


def profile(html: Column, node: Column) -> Column:
    """PROFILE of a page from its business data (a variant, null if none), then from the page itself."""
    get = lambda path, kind="string": F.try_variant_get(node, path, kind)
    fill = lambda *cs: F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs])
    place = [get(f'$.address["{k}"]') for k in ("streetAddress", "addressLocality", "postalCode", "addressRegion")]
    parts = F.concat_ws(", ", *[F.when(p != "", p) for p in place])
    is_object = F.coalesce(F.schema_of_variant(get("$.address", "variant")).startswith("OBJECT"), F.lit(False))
    address = F.when(is_object, F.when(parts != "", parts)).otherwise(fill(get("$.address")))
    none = F.array().cast("array<string>")
    lists = lambda path: F.coalesce(get(path, "array<string>"), F.when(get(path).isNotNull() & (get(path) != ""), F.array(get(path))), none)
    links = hrefs(html)
    mail = F.get(F.filter(links, lambda h: F.lower(h).startswith("mailto:")), F.lit(0))
    mail = F.lower(F.trim(F.substring_index(F.substring(mail, F.lit(8), F.length(mail)), "?", 1)))
    tel = F.filter(F.transform(F.filter(links, lambda h: F.lower(h).startswith("tel:")), lambda h: F.trim(F.substring(h, F.lit(5), F.length(h)))), lambda t: t != "")
    return F.struct(
        F.coalesce(fill(get("$.name"), get("$.legalName"), title(html), heading(html)), F.lit("")).alias("name"),
        address.alias("address"),
        F.array_distinct(F.concat(lists("$.telephone"), tel)).alias("phones"),
        fill(F.lower(get("$.email")), contacts.first_email(visible_text(html)), mail).alias("email"),
        F.array_distinct(F.concat(lists("$.sameAs"), urls.social_links(links))).alias("socials"),
        F.coalesce(get("$.aggregateRating.ratingValue", "double"), F.lit(0.0)).alias("rating"),
        F.coalesce(get("$.aggregateRating.reviewCount", "int"), F.lit(0)).alias("reviews"),
    ).cast(PROFILE)


def social_profile(html: Column, node: Column) -> Column:
    """struct<name, description, industry, email, address> of a social page: shared tags, embedded data, title."""
    get = lambda path: F.try_variant_get(node, path, "string")
    fill = lambda *cs: F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs])
    suffixless = F.trim(F.regexp_extract(title(html), r"^(.*?)(?:\s*[|\-–]\s*.*)?$", 1))
    return F.struct(
        F.coalesce(fill(meta(html, "og:title"), get("$.name"), suffixless), F.lit("")).alias("name"),
        F.coalesce(fill(meta(html, "og:description"), get("$.description")), F.lit("")).alias("description"),
        F.coalesce(fill(meta(html, "og:type")), F.lit("Social Profile")).alias("industry"),
        F.lower(get("$.email")).alias("email"),
        fill(get("$.address.streetAddress"), get("$.address")).alias("address"),
    )


def search_results(html: Column) -> Column:
    """array<struct<title, url, snippet>> of a results page: titled anchors with unwrapped targets, in order."""
    blocks = F.regexp_extract_all(body(html), F.lit(r'(?is)<a\b[^>]*class\s*=\s*"[^"]*\bresult__a\b[^"]*"[^>]*>.*?</a\s*>(?:(?!result__a").)*'), F.lit(0))

    def made(b: Column) -> Column:
        a = F.regexp_extract(b, r"(?is)^<a\b[^>]*>", 0)
        return F.struct(
            strip_tags(F.regexp_extract(b, r"(?is)^<a\b[^>]*>(.*?)</a\s*>", 1)).alias("title"),
            urls.unwrap_redirect(F.replace(attribute(a, "href"), F.lit("&amp;"), F.lit("&"))).alias("url"),
            strip_tags(F.regexp_extract(b, r'(?is)<a\b[^>]*class\s*=\s*"[^"]*\bresult__snippet\b[^"]*"[^>]*>(.*?)</a\s*>', 1)).alias("snippet"),
        )

    return F.filter(F.transform(blocks, made), lambda r: (r["title"] != "") & (r["url"] != ""))


