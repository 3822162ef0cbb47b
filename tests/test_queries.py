"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import glob
import math
import os

import duckdb
import pytest

from leadweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert got == rows(found.columns, found.fetchall())


ODD_PAGES = [
    "<title>k = &quot;v&quot; &lt;b&gt; &#39;x&#39; &#x27;&nbsp;&amp;lt; R&amp;D</title>", "<title>a <b>bold</b> < b > c</title>", None, "", "<title></title>", "no title <a href=x>", "<TITLE lang=a>Big\n\t one</TITLE\n>", "<titles>no</titles><title>yes</title><title>no</title>",
    "<title>\u00a0a\u00a0\u00a0b\u3000</title>", "<title>\u2003 \u00a0</title>", "<title>a\x0bb\u0085c\u2028d\x0b</title>", "<title>open", "<title>a</title\x0b>b</title >", "<titleé>x</title>", "<title>é\U0001f600</title><aé href=y><a_ href=z>",
    "<a href=''><a HREF><a data-href=x><a title='href'><a\nhref = \"x\"><a name=n><area href=x><a x><a <a href><a href", "<!-- <title>no</title><a href=1> --><title>t</title><!-- <a href=2>", "<script>'<a href=1>'</script><\u017fcript>'<a href=2>'</\u017fcript><\u017ftyle><a href=3></style\x0b><a href=4></STYLE\f><a href=5>",
    "<script>var t = '<title>no</title>'</script\u00a0><title>in</title></script><title>out</title>", "<scripted><title>in</title></script>", "<scripté><title>no</title></script><title>out</title>", "<title><script>no</script><!-- no -->a</title>", "<title>$1 \\\\ \\1 &amp;amp;quot;</title>", "<t\u0131tle>x</t\u0131tle><t\u0130tle>y</title>",
]


def test_odd_page_titles(spark, tmp_path):
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'https://a.dz/', ?)", list(enumerate(ODD_PAGES)))
    con.sql(f"COPY pages TO '{tmp_path}/pages.parquet'")
    df = catalogue.queries()["page_titles"](spark, str(tmp_path))
    found = con.sql(catalogue.oracle_sql()["page_titles"])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
    assert df.filter("page_id = 0").first()["title"] == "k = &quot;v&quot; &lt;b&gt; &#39;x&#39; &#x27;&nbsp;&lt; R&D"
