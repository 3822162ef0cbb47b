"""From fetched material to records: search results, map responses, pages; unions and first-wins deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions import contacts, dates, urls
from leadweave.functions import html as H
from leadweave.functions.text import first_of_each as distinct_ignoring_case
from leadweave.functions.text import fingerprint, name_label, or_empty, sanitised_query
from leadweave.functions.values import joined_parts
from leadweave.operators.frames import pinned
from leadweave.operators.store import first_of_each
from leadweave.sources import catalogues

COUNTRY = "Algérie"
MODIFIERS = ("Algérie", "DZ", "Algeria")


def expand_queries(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``variants``: the sanitised query and its dialect variants, or it with the country's names; null if it is refused."""
    columns = df.columns
    df = pinned(df, __clean=sanitised_query(F.col(query)))
    df = pinned(df, __known=catalogues.dialect_variants(F.col("__clean")))
    clean, known = F.col("__clean"), F.col("__known")
    plain = F.array(clean, *[F.concat(clean, F.lit(" " + m)) for m in MODIFIERS])
    every = F.when(known.isNotNull(), F.concat(F.array(clean), known)).otherwise(plain)
    made = distinct_ignoring_case(F.filter(F.transform(every, sanitised_query), lambda v: v.isNotNull()))
    return df.select(*columns, F.when(F.trim(or_empty(F.col(query))) == "", F.array().cast("array<string>")).when(clean.isNotNull(), made).alias("variants"))


def search_text(query: Column, region: Column) -> Column:
    return F.concat_ws(" ", query, F.when(region != "", region), F.lit(COUNTRY))


def _record(df: DataFrame, *, now: Column, **columns: Column) -> DataFrame:
    """Rows of raw_records (but ids) from the given columns; phones is an array of validated numbers, fresh a freshness struct."""
    none = F.lit(None).cast("string")
    made = pinned(df, **{f"__{k}": v for k, v in columns.items()})
    has = lambda k: F.col(f"__{k}") if k in columns else none
    phone = F.coalesce(F.get("__phones", F.lit(0))["e164"], has("plain_phone"))
    out = made.select(
        name_label(has("name")).alias("name"), has("industry").alias("industry"), F.coalesce(F.when(has("wilaya") != "", has("wilaya")), F.lit("Unknown")).alias("wilaya"), has("address").alias("address"), has("website").alias("website"),
        phone.alias("phone"), has("email").alias("email"), (F.col("__socials") if "socials" in columns else F.array().cast("array<string>")).alias("social_media_handles"),
        (F.col("__rating") if "rating" in columns else F.lit(0.0)).alias("rating"), (F.col("__reviews") if "reviews" in columns else F.lit(0)).alias("review_count"),
        (F.col("__lat") if "lat" in columns else F.lit(None).cast("double")).alias("latitude"), (F.col("__lon") if "lon" in columns else F.lit(None).cast("double")).alias("longitude"),
        has("source").alias("source"), has("source_url").alias("source_url"), F.col("__phones").alias("phone_metadata"), now.alias("discovered_at"), F.col("__fresh.last_updated").alias("last_updated"),
        F.col("__fresh.relative_age_hint").alias("relative_age_hint"), F.col("__fresh.calculated_age_class").alias("calculated_age_class"), now.alias("created_at"), *[F.col(c) for c in ("ord",) if c in df.columns],
    )
    return out.withColumn("fingerprint", fingerprint(F.col("name"), F.col("wilaya"), F.col("phone"), F.col("website")))


def records_of_results(results: DataFrame, now: Column, query: str, wilaya: str | None = None) -> DataFrame:
    """Records of search results (title, url, snippet, ord): three characters of title at least, a URL, no directories."""
    url, title = urls.clean(F.col("url")), F.trim(or_empty(F.col("title")))
    good = results.withColumn("url", url).withColumn("title", title).filter((F.length("title") >= 3) & (F.col("url") != "") & ~urls.is_directory(F.col("url"), F.col("title")))
    text = F.concat_ws(" ", F.col("title"), F.trim(or_empty(F.col("snippet"))))
    return _record(good, now=now, name=F.col("title"), industry=F.initcap(F.lit(query)) if query else F.lit("Other"), wilaya=F.lit(wilaya or ""), website=F.col("url"), phones=contacts.phones(text), email=contacts.first_email(F.col("snippet")), fresh=dates.freshness(F.col("snippet"), now), source=F.lit("duckduckgo"), source_url=F.col("url"))


def records_of_pages(pages: DataFrame, now: Column) -> DataFrame:
    """Records of crawled pages (url, html): those with a name of three characters at least that are no directories."""
    with_profile = pinned(pinned(pages, node=H.json_ld(F.col("html"))), p=H.profile(F.col("html"), F.col("node")))
    good = with_profile.filter((F.length("p.name") >= 3) & ~urls.is_directory(F.col("url"), F.col("p.name")))
    text = F.concat_ws(" ", F.col("p.name"), F.coalesce("p.address", F.lit("None")), F.array_join("p.phones", " "))
    return _record(good, now=now, name=F.col("p.name"), industry=F.lit("Auto-Discovered"), wilaya=F.lit("Unknown"), address=F.col("p.address"), website=F.col("url"), phones=contacts.phones(text), email=F.col("p.email"), socials=F.col("p.socials"), fresh=dates.freshness(F.col("html"), now), source=F.lit("infinite"), source_url=F.col("url"))


def records_of_profiles(pages: DataFrame, now: Column, kind: str = "social") -> DataFrame:
    """Records of social pages (url, html): of the four hosts, no login walls, with a name."""
    four = F.lit(False)
    for h in ("facebook.com", "instagram.com", "tiktok.com", "linkedin.com"):
        four = four | urls.host(F.col("url")).contains(h)
    good = pages.filter(four & ~H.is_login_wall(F.col("html"), kind))
    good = pinned(good, p=H.social_profile(F.col("html"), H.json_ld(F.col("html")))).filter(F.col("p.name") != "")
    return _record(good, now=now, name=F.col("p.name"), industry=F.col("p.industry"), address=F.col("p.address"), website=F.col("url"), phones=contacts.phones(F.concat_ws(" ", "p.name", "p.description")), email=F.col("p.email"), socials=F.array("url"), fresh=dates.freshness(F.col("html"), now), source=F.lit("social"), source_url=F.col("url"))


_ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,timestamp:string,tags:map<string,string>>>>"


def records_of_map(responses: DataFrame, now: Column, query: str, wilaya: str | None = None) -> DataFrame:
    """Records of map responses (json), each fingerprint once: the first element with it."""
    e = responses.select(F.posexplode(F.from_json("json", _ELEMENTS)["elements"]).alias("ord", "e"))
    tag = lambda *ks: F.coalesce(*[F.when(F.element_at("e.tags", k) != "", F.element_at("e.tags", k)) for k in ks])
    named = e.withColumn("label", tag("name", "name:fr", "name:en")).filter(F.col("label").isNotNull())
    plain = tag("phone", "contact:phone")
    made = _record(
        named, now=now, name=F.col("label"), industry=F.coalesce(catalogues.map_industry(F.col("e.tags")), F.initcap(F.lit(query)) if query else F.lit("Other")), wilaya=F.lit(wilaya or ""),
        address=joined_parts(*[F.element_at("e.tags", f"addr:{k}") for k in ("housenumber", "street", "city", "postcode")]), website=tag("website", "contact:website", "url"), phones=contacts.phones(plain), plain_phone=plain,
        email=F.lower(tag("email", "contact:email")), rating=F.coalesce(tag("stars").try_cast("double"), F.lit(0.0)), lat=F.coalesce("e.lat", "e.center.lat"), lon=F.coalesce("e.lon", "e.center.lon"),
        fresh=dates.freshness(F.col("e.timestamp"), now), source=F.lit("overpass"), source_url=F.concat(F.lit("https://www.openstreetmap.org/"), F.coalesce("e.type", F.lit("node")), F.lit("/"), F.coalesce(F.col("e.id").cast("string"), F.lit(""))),
    )
    return first_of_each(made, ["fingerprint"], [F.col("ord")])


def enrich(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Records with what their own pages say (website, and p: a PROFILE): name and address are taken over, a missing e-mail
    is filled, socials are united up to ten, and phones are validated again with those found."""
    found = profiles.select(F.col("website").alias("__site"), F.col("p").alias("__p"))
    j = records.join(found, records["website"] == F.col("__site"), "left")
    more = contacts.distinct_phones(F.concat(F.coalesce("phone_metadata", F.array().cast(f"array<{contacts.PHONE_TYPE}>")), contacts.phones(F.array_join("__p.phones", " "))))
    new_phones = F.size(contacts.phones(F.array_join("__p.phones", " "))) > 0
    changed = {
        "name": F.when(F.length("__p.name") > 2, name_label(F.col("__p.name"))).otherwise(F.col("name")),
        "address": F.coalesce("__p.address", "address"),
        "email": F.coalesce(F.when(F.col("email") != "", F.col("email")), "__p.email"),
        "social_media_handles": F.when(F.size("__p.socials") > 0, F.slice(F.array_union(F.coalesce("social_media_handles", F.array().cast("array<string>")), "__p.socials"), 1, 10)).otherwise(F.col("social_media_handles")),
        "phone_metadata": F.when(new_phones, more).otherwise(F.col("phone_metadata")),
        "phone": F.when(new_phones, F.get(more, F.lit(0))["e164"]).otherwise(F.col("phone")),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in records.columns])


def discover(sources: list[DataFrame], limit: int) -> DataFrame:
    """Records of several sources (each with ``ord``, the place within it), the first of each fingerprint, ``limit`` of them."""
    tagged = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    return first_of_each(every, ["fingerprint"], [F.col("__source"), F.col("ord")]).orderBy("__source", "ord").limit(limit).drop("__source", "ord")


def over_fetch(limit: int) -> int:
    """How many rows to ask of each source for ``limit`` in the end."""
    return max(2 * limit, limit + 5)
