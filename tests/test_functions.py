"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from leadweave.functions import contacts, html, text, urls, values
from leadweave.operators import search
from leadweave.sources import catalogues


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, e164",
    [("0555 12 34 56", "+213555123456"), ("+213 770 11 22 33", "+213770112233"), ("garbage", None), ("021 45 67 89", "+21321456789"), ("+33 6 12 34 56 78", None), ("", None)],
)
def test_one_phone(spark, raw, e164):
    got = one(spark, contacts.phone(F.lit(raw)))
    assert (got and got["e164"]) == e164


def test_phone_forms(spark):
    p = one(spark, contacts.phone(F.lit("0555123456")))
    assert (p["international"], p["national"], p["phone_type"], p["is_valid"]) == ("+213 555 12 34 56", "0555 12 34 56", "MOBILE", True)


def test_two_spellings_are_one_phone(spark):
    assert len(one(spark, contacts.phones(F.lit("0555 12 34 56 / +213555123456")))) == 1


@pytest.mark.parametrize(
    "base, href, url",
    [
        ("http://a.dz/x/y?q", "z", "http://a.dz/x/z"), ("http://a.dz/x/y", "/z#f", "http://a.dz/z"), ("http://a.dz/x/y/", "../z", "http://a.dz/x/z"), ("http://a.dz", "z", "http://a.dz/z"), ("https://a.dz/b", "//c.dz/d", "https://c.dz/d"),
        ("http://a.dz/x/y/z", "../../w", "http://a.dz/w"), ("http://a.dz/x", "mailto:a@b", ""), ("http://a.dz/x?y", "?q=1", "http://a.dz/x?q=1"), ("http://a.dz/x", "", ""), ("http://a.dz/x", "./z", "http://a.dz/z"),
    ],
)
def test_relative_urls(spark, base, href, url):
    assert one(spark, urls.resolve(F.lit(base), F.lit(href))) == url


def test_social_links(spark):
    links = F.array(*[F.lit(x) for x in ("https://facebook.com/a", "https://facebook.com/sharer.php?u=x", "https://a.dz", "https://facebook.com/a", "https://x.com/b")])
    assert one(spark, urls.social_links(links)) == ["https://facebook.com/a", "https://x.com/b"]


def test_extra_directories(spark):
    assert one(spark, urls.is_directory(F.lit("https://my.list.dz/"), F.lit("x"), hosts=("list.dz",)))
    assert one(spark, urls.is_directory(F.lit("https://a.dz/"), F.lit("Our catalogue"), titles=("catalogue",)))
    assert not one(spark, urls.is_directory(F.lit("https://facebook.com/shop"), F.lit("Shop")))


def test_list_types_of_embedded_data(spark):
    page = F.lit('<script type="application/ld+json">{"@type":["Store","Thing"],"name":"N"}</script>')
    assert one(spark, html.json_ld(page)) is None
    assert one(spark, F.try_variant_get(html.json_ld(page, list_types=True), "$.name", "string")) == "N"


def test_dialect(spark):
    assert len(one(spark, catalogues.dialect_variants(F.lit("pharma")))) >= 10
    assert one(spark, catalogues.dialect_variants(F.lit("zzz"))) is None and one(spark, catalogues.dialect_variants(F.lit(""))) is None


def test_values(spark):
    assert one(spark, values.list_setting(F.lit(" a, ,b,"))) == ["a", "b"]
    assert one(spark, values.string_list(F.lit("nonsense"))) == [] and one(spark, values.string_list(F.lit('["a"," b "]'))) == ["a", " b "]
    assert one(spark, values.joined_parts(F.lit(""), F.lit(None).cast("string"))) is None
    assert one(spark, text.first_of_each(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b")))) == ["A", "b"]


def test_search_query():
    assert search.parse_query('Café "Rue de" oran*') == [[("cafe", False)], [("rue", False), ("de", False)], [("oran", True)]]


def test_catalogue_sizes(spark):
    assert catalogues.regions(spark).count() == 58 and catalogues.industries(spark).count() == 14 and catalogues.services(spark).count() == 10 and catalogues.dialect(spark).count() == 14
