from linkloom.plans.analysis import Settings, analyse
from linkloom.sources import pages as pg

SITE = {
    "http://s.example/robots.txt": "User-agent: *\nDisallow: /no/\n", "http://s.example/": '<p>cat dog <a href="/a">a</a> <a href="/no/x">n</a>', "http://s.example/a": '<meta name="robots" content="noindex"><p>dog dog <a href="/">h</a> <a href="/b">b</a>',
    "http://s.example/b": "<p>bird", "http://s.example/no/x": "<p>never",
}


def fetcher(spark):
    known = spark.createDataFrame(list(SITE.items()), "url string, html string")
    return lambda wanted: wanted.join(known, "url", "left")


def test_whole_site(spark, rows, tmp_path):
    site = analyse(spark, Settings("HTTP://S.example", print_paths=True, topics=2, filter_factor=1.0), fetcher(spark))
    assert rows(site.edges) == [("http://s.example/", "http://s.example/a"), ("http://s.example/a", "http://s.example/"), ("http://s.example/a", "http://s.example/b")]
    s = site.summary()
    assert (s["vertices"], s["total_in"], s["pairs"], s["diameter"], s["radius"]) == (3, 3, 6, 2, 2)
    counts = {(t, u.rsplit("/", 1)[1]): n for t, u, n in rows(site.term_counts(), "term", "url", "n")}
    assert counts["dog", "a"] == 2
    m = site.topics()
    assert {r["url"] for r in site.filtered(m).collect()} == {r["url"] for r in site.vertices.collect()}
    assert site.filtered(m, 5.0).count() == 0
    site.save(str(tmp_path))
    assert {p.name for p in (tmp_path / "HTTPS.example").iterdir()} == {"pages", "inDistribution", "outDistribution", "pagerank", "paths"}
    assert spark.read.text(str(tmp_path / "HTTPS.example" / "inDistribution")).count() == 3
    left = analyse(spark, Settings("http://s.example/", leave_noindex=True), fetcher(spark))
    assert "http://s.example/a" not in {r["url"] for r in left.term_counts().collect()}


def test_html_files(spark, tmp_path):
    (tmp_path / "x.html").write_text("<p>a\nb")
    assert [r["html"] for r in pg.read_html_files(spark, str(tmp_path)).collect()] == ["<p>a\nb"]


def test_media_types(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("Text/HTML; x",), ("image/png",), (None,)], "t string").select(pg.acceptable(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, False]
