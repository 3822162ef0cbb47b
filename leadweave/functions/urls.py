"""Column functions over URLs: parts, clean-up, classification."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions.text import or_empty

# Hosts that only list other businesses.
DIRECTORY_HOSTS = (
    "cybo.com", "yellowpages.com", "pagesjaunes.fr", "lespagesjaunes-algerie.com", "ouedkniss.com", "ouedkniss.fr", "tripadvisor.com", "tripadvisor.fr", "yelp.com", "reddit.com",
    "findhealthclinics.com", "rentechdigital.com", "sante-dz.com", "sante-dz.org", "med.tn", "expat.com", "petitfute.com", "africabizinfo.com", "annuaire-algerie.com", "elmouchir.caci.dz",
)
# Parts of a path, then of a title, that mark a list of results.
DIRECTORY_PATHS = ("/search/", "/directory/", "/annuaire/", "/liste-", "/results", "/classement")
DIRECTORY_TITLES = ("résultats", "results", "liste des", "list of", "page 1", "page 2", "les meilleurs", "the best", "annuaire", "directory", "classement", "top 10", "top 20", "yellow pages", "pages jaunes")
# Social hosts and their platforms, the first that occurs wins; share buttons are no profiles.
SOCIAL_HOSTS = (("facebook.com", "facebook"), ("instagram.com", "instagram"), ("linkedin.com", "linkedin"), ("twitter.com", "twitter"), ("x.com", "twitter"), ("tiktok.com", "tiktok"), ("youtube.com", "youtube"), ("pinterest.com", "pinterest"))
SHARE_PARTS = ("/sharer", "/share?", "/share/", "sharer.php", "/intent/", "/plugins/", "/widgets/")
# Fixed value: the search engine's redirect host and parameter.
REDIRECT_HOST, REDIRECT_PARAM = "duckduckgo.com", "uddg"

#: scheme, host with port, path, query with ``?``, fragment; works on URLs that strict parsers refuse.
SPLIT = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(or_empty(url), SPLIT, k)


def host(url: Column) -> Column:
    """Lower-case host, with its port; none: empty."""
    return part(F.lower(url), 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return (bare_host(a) == bare_host(b)) & (bare_host(a) != "")


def url_key(url: Column) -> Column:
    """Host without a leading www., path without slashes at its end, and the query."""
    low = F.lower(url)
    query = part(low, 3)
    return F.concat(bare_host(url), F.rtrim(part(low, 2), F.lit("/")), F.when(query == "?", "").otherwise(query))


def clean(url: Column) -> Column:
    """Absolute http(s) URL without its fragment; ``//host`` gets https; anything else: empty."""
    c = F.trim(or_empty(url))
    c = F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)
    return F.when(c.startswith("http://") | c.startswith("https://"), F.regexp_replace(c, "(?s)#.*$", "")).otherwise("")


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``, cleaned; dot segments are folded."""
    origin = F.regexp_extract(or_empty(base), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(origin, r"^([^:]*:)", 1)
    folder = F.regexp_replace(part(base, 2), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    h = F.trim(or_empty(href))
    joined = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, part(base, 2), h))
        .otherwise(F.concat(origin, folder, h))
    )
    joined = F.regexp_replace(joined, r"/(\./)+", "/")
    # each step folds one pair, so as many steps as there are parent segments
    ups = F.size(F.split(joined, r"/(?=\.\./)")) - 1
    fold = lambda path, _: F.regexp_replace(path, r"(://[^/?#]*(?:/[^?#]*)?)/(?!\.\./)[^/?#]+/\.\./", "$1/")
    joined = F.when(ups > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(ups, F.lit(1))), joined, fold)).otherwise(joined)
    joined = F.regexp_replace(joined, r"(://[^/?#]*)/(?:\.\./)+", "$1/")
    return F.when((h == "") | (or_empty(base) == ""), "").otherwise(clean(joined))


def unwrap_redirect(url: Column) -> Column:
    """Target of a search engine's redirect, decoded; other URLs are just cleaned."""
    c = or_empty(url)
    full = F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).when(c.startswith("/"), F.concat(F.lit(f"https://{REDIRECT_HOST}"), c)).otherwise(c)
    target = F.regexp_extract(part(full, 3), rf"[?&]{REDIRECT_PARAM}=([^&]*)", 1)
    once = F.try_url_decode(target)
    # the second decoding leaves plus signs alone
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return F.when(part(full, 1).contains(REDIRECT_HOST) & (target != ""), clean(twice)).otherwise(clean(full))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _one_of(parts: tuple[str, ...]) -> str:
    return "|".join(re.escape(p) for p in parts)


def is_directory(url: Column, title: Column | None = None, hosts: tuple[str, ...] = (), titles: tuple[str, ...] = ()) -> Column:
    """Spam: no URL, a directory's host or one under it, a results path, or a title of lists. More hosts and titles may be given."""
    found = (or_empty(url) == "") | bare_host(url).rlike(rf"(?:^|\.)(?:{_one_of((*DIRECTORY_HOSTS, *hosts))})$") | part(F.lower(url), 2).rlike(_one_of(DIRECTORY_PATHS))
    return found if title is None else found | F.lower(or_empty(title)).rlike(_one_of((*DIRECTORY_TITLES, *titles)))


def platform(url: Column) -> Column:
    """Social platform by the first host that occurs anywhere in the URL, else null."""
    low = F.lower(or_empty(url))
    out = F.when(low.contains(SOCIAL_HOSTS[0][0]), SOCIAL_HOSTS[0][1])
    for h, name in SOCIAL_HOSTS[1:]:
        out = out.when(low.contains(h), name)
    return out


def social_links(hrefs: Column) -> Column:
    """Profile links of an array, in order, each once; share buttons and other hosts go."""
    good = F.filter(hrefs, lambda h: h.isNotNull() & (h != "") & ~_any([F.lower(h).contains(p) for p in SHARE_PARTS]) & _any([F.lower(h).contains(s) for s, _ in SOCIAL_HOSTS]))
    return F.array_distinct(good)


def is_crawlable(href: Column, absolute: Column) -> Column:
    """A link worth queueing: no anchor, script, mail or phone link, and absolute after resolution."""
    h = F.trim(or_empty(href))
    return (h != "") & ~h.startswith("#") & ~h.startswith("javascript:") & ~h.startswith("mailto:") & ~h.startswith("tel:") & (absolute != "")
