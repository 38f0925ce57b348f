import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import links, robots


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "u string").select(f(F.col("u")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("HTTP://A.example:80/X?q#f", "http://a.example/X"), ("https://A.example:443", "https://a.example/"), ("https://a.example:80/", "https://a.example:80/"),
        ("http://a.example#x?y", "http://a.example/"), ("mailto:x@y", "mailto:x@y"), ("", ""), (None, None), ("http://a.example/ü", "http://a.example/ü"),
    ],
)
def test_canonical(spark, given, wanted):
    assert one(spark, urls.canonical, given) == wanted


def test_host_and_path(spark):
    assert one(spark, urls.host_of, "http://u@WWW.A.example:81/x") == "www.a.example"
    assert one(spark, urls.host_of, "nothing") is None
    for given, wanted in (("http://a/", "index.html"), ("http://a/x", "x/index.html"), ("http://a/x/", "x/index.html"), ("http://a/x.d/y", "x.d/y/index.html"), ("http://a/x.html", "x.html"), (None, None)):
        assert one(spark, urls.file_path, given) == wanted
    assert one(spark, urls.directory_name, "a:b/c*d") == "abcd"


PAGE = """<a href="/x">1</a> <A class=c HREF="y?q">2</A> <a href='/single'>no</a> <!-- <a href="/comment#t">3</a> -->
<a href="#top">4</a> <a href="mailto:m@n">5</a> <a href="file:///etc">6</a> <a href="http://other.example/">7</a> <a href="https://a.example/z">8</a> <a href="a b">9</a> <a href="//A.example:80/w">10</a> <a href="/x">1</a>"""


def test_resolve_and_disposition(spark, rows):
    pages = spark.createDataFrame([(1, "http://a.example/d/p", PAGE), (2, None, PAGE), (3, "http://a.example/q", None)], "page_id long, url string, html string")
    found = links.resolved(pages)
    assert [r["target"] for r in found.orderBy("pos").collect()] == [
        "http://a.example/x", "http://a.example/y", "http://a.example/comment", "http://a.example/", None, None, "http://other.example/", "https://a.example/z", None, "http://a.example/w", "http://a.example/x",
    ]
    assert ("http://a.example/d/y",) in rows(links.resolved(pages, mode="page"), "target")
    invalid = spark.createDataFrame([("http://A.example/w",), (None,)], "url string")
    rules = spark.createDataFrame([("a.example", "/comm")], "host string, prefix string")
    kinds = {r["href"]: r["disposition"] for r in links.disposition(found, invalid, rules, "prefix").collect()}
    assert kinds == {
        "/x": "admitted", "y?q": "admitted", "/comment#t": "disallowed", "#top": "admitted", "mailto:m@n": "malformed", "file:///etc": "file",
        "http://other.example/": "external", "https://a.example/z": "external", "a b": "malformed", "//A.example:80/w": "invalid",
    }
    # the directory of a rule without a last slash is the root
    assert {r["disposition"] for r in links.disposition(found, invalid, rules).collect()} == {"disallowed", "malformed", "file", "external", "invalid"}
    with pytest.raises(ValueError):
        links.resolved(pages, mode="other")


def test_admitted_keeps_repeats(spark, rows):
    e = spark.createDataFrame([("http://a/1", "http://a/2"), ("http://a/1", "http://A/2#x"), ("http://a/1", None), ("http://a/1", "http://a/no/3"), ("http://a/1", "http://a/bad")], "src string, dst string")
    got = links.admitted(e, spark.createDataFrame([("http://a/bad",)], "url string"), spark.createDataFrame([("a", "/no/")], "host string, prefix string"))
    assert rows(got) == [("http://a/1", "http://a/2")] * 2


def test_robots(spark, rows):
    body = "User-agent: x\nDisallow: /x\nuser-AGENT : *\r\nDisallow: /a\r\nDisallow:/b/ \nAllow: /c\nDisallow: /d\nUser-agent: *\nUser-agent: *\nDisallow: /e\nUser-agent: *\nDisallow: /\nUser-agent: *\nDisallow: /f"
    data = [("A.example", body), ("a.example", body), ("b", None), (None, body), ("c", ""), ("d", "User-agent: *\nDisallow:\nDisallow: /g")]
    # the second of two agent lines, and the agent line that ends a run, are spent
    assert rows(robots.rules(spark.createDataFrame(data, "host string, body string"))) == [("a.example", "/"), ("a.example", "/a"), ("a.example", "/b/")]
