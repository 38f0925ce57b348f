import random
from collections import deque

import pytest

from linkloom.operators import crawl, graph, pagerank, paths, reports
from linkloom.sources import sinks


def frame(spark, v, e):
    return spark.createDataFrame([(x,) for x in v], "url string"), spark.createDataFrame(e, "src string, dst string")


def bfs(v, e):
    """Distances with cycles on the diagonal, and the smallest next vertex."""
    out = {}
    for a, b in e:
        if a in v and b in v:
            out.setdefault(a, set()).add(b)
    dist = {}
    for s in v:
        seen, todo = {}, deque((n, 1) for n in out.get(s, ()))
        while todo:
            u, k = todo.popleft()
            if u not in seen:
                seen[u] = k
                todo.extend((n, k + 1) for n in out.get(u, ()))
        dist.update({(s, t): k for t, k in seen.items()})
    nxt = {(s, t): min(n for n in out[s] if (n == t and k == 1) or dist.get((n, t)) == k - 1 and k > 1 and n != t) for (s, t), k in dist.items()}
    return dist, nxt


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_all_pairs_against_search(spark, seed, limit):
    rng = random.Random(seed)
    v = [f"v{k}" for k in range(9)]
    e = [(rng.choice(v), rng.choice([*v, "gone"])) for _ in range(16)]
    dist, nxt = bfs(v, e)
    vertices, edges = frame(spark, v, e)
    found = paths.all_pairs(edges, vertices, limit=limit)
    assert {(r["src"], r["dst"]): (r["dist"], r["next"]) for r in found.collect()} == {k: (dist[k], nxt[k]) for k in dist}
    ways = paths.shortest(edges, vertices, limit=limit).collect()
    assert {(r["src"], r["dst"]): r["dist"] for r in ways} == dist
    for r in ways:
        at, steps = r["src"], []
        while at != r["dst"] or (r["src"] == r["dst"] and not steps):
            if r["src"] == r["dst"]:
                break
            at = nxt[at, r["dst"]]
            steps.append(at)
        assert r["path"] == steps
    s = paths.distance_summary(found, vertices).first()
    ecc = {x: max((k for (a, _), k in dist.items() if a == x), default=0) for x in v}
    assert (s["pairs"], s["diameter"], s["radius"]) == (len(dist), max(ecc.values()), min((x for x in ecc.values() if x), default=None))


def test_small_graphs(spark, rows):
    v, e = frame(spark, "abc", [("a", "b"), ("b", "c"), ("c", "c")])
    found = paths.all_pairs(e, v)
    assert rows(found) == [("a", "b", 1, "b"), ("a", "c", 2, "b"), ("b", "c", 1, "c"), ("c", "c", 1, "c")]
    assert rows(paths.all_pairs(e, v, deepest=1)) == [("a", "b", 1, "b"), ("b", "c", 1, "c"), ("c", "c", 1, "c")]
    urls, links = frame(spark, ["http://s/a", "http://s/b"], [("http://s/a", "http://s/b")])
    report = {(r["src"], r["dst"]): r["report"] for r in paths.path_report(paths.shortest(links, urls), urls).collect()}
    assert len(report) == 4
    assert report["http://s/a", "http://s/b"] == "Path from http://s/a to http://s/b\nhttp://s/b\n"
    assert report["http://s/b", "http://s/a"] == "Path from http://s/b to http://s/a\n"
    none_v, none_e = frame(spark, [], [])
    assert paths.distance_summary(paths.all_pairs(none_e, none_v), none_v).first()[:4] == (0, None, 0, None)
    assert pagerank.pagerank(none_v, none_e).count() == 0


def plain_rank(v, e, steps, dedupe=False):
    links = sorted(set(e)) if dedupe else e
    out = {u: sum(a == u for a, _ in links) for u in v}
    r = dict.fromkeys(v, 1 / len(v))
    for _ in range(steps):
        r = {x: 0.15 / len(v) + 0.85 * sum(r[a] / out[a] for a, b in set(e) if b == x) for x in v}
    return r


@pytest.mark.parametrize("dedupe", [False, True])
def test_pagerank(spark, dedupe):
    v, e = list("abcd"), [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "c"), ("c", "a")]
    vertices, edges = frame(spark, v, e)
    got = {r["url"]: r["pagerank"] for r in pagerank.pagerank(vertices, edges, steps=7, dedupe=dedupe).collect()}
    assert got == {k: pytest.approx(x) for k, x in plain_rank(v, e, 7, dedupe).items()}


def test_pagerank_stops(spark):
    v, e = frame(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")])
    full = {r["url"]: r["pagerank"] for r in pagerank.pagerank(v, e, steps=200, tol=1e-9).collect()}
    again = {r["url"]: r["pagerank"] for r in pagerank.pagerank(v, e, steps=150).collect()}
    assert full == {k: pytest.approx(x, abs=1e-7) for k, x in again.items()}
    assert sum(full.values()) == pytest.approx(1)
    early = pagerank.pagerank(v, e, steps=200, tol=0.5, stop="any")
    assert early.count() == 3
    with pytest.raises(ValueError):
        pagerank.pagerank(v, e, stop="some")


def test_prune_degrees_summary(spark, rows):
    docs = spark.createDataFrame([("http://A/1", True), ("http://a/1", True), ("http://a/2", True), ("http://a/3", False), ("http://a/4", None), (None, True)], "url string, analyzed boolean")
    v = graph.prune_documents(docs, spark.createDataFrame([("http://a/2#x",), (None,)], "url string"))
    assert rows(v) == [("http://a/1",)]
    v, e = frame(spark, ["http://a/1", "http://a/2"], [("http://a/1", "http://A/1"), ("http://a/1", "http://a/1"), ("http://a/1", "http://a/9"), ("http://a/2", None)])
    e = graph.prune_edges(e, v)
    assert rows(graph.multiplicity(e)) == [("http://a/1", "http://a/1", 2)]
    assert rows(graph.degrees(v, e)) == [("http://a/1", 2, 2), ("http://a/2", 0, 0)]
    assert rows(graph.summary(v, e)) == [(2, 2, 2, 1.0, 1.0)]
    assert rows(graph.summary(v.limit(0), e.limit(0))) == [(0, 0, 0, None, None)]
    assert rows(graph.distribution(v, e, "in")) == [(1, "http://a/1", 2), (2, "http://a/2", 0)]


def test_crawl(spark, rows):
    html = {"http://s/": '<a href="/a">x</a><a href="/a">x</a><a href="/no/x">x</a><a href="http://t/">x</a>', "http://s/a": '<a href="/b">x</a><a href="/gone">x</a>', "http://s/b": '<a href="/">x</a>', "http://s/no/x": "y"}
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(html.items())], "page_id long, url string, html string")
    seeds, rules = spark.createDataFrame([("http://s/",)], "url string"), spark.createDataFrame([("s", "/no/")], "host string, prefix string")
    invalid = spark.createDataFrame([], "url string")
    visited, edges, failed = crawl.crawl(seeds, crawl.snapshot_fetcher(pages), rules, invalid)
    assert rows(visited) == [("http://s/", 0), ("http://s/a", 1), ("http://s/b", 2)]
    assert rows(edges) == [("http://s/", "http://s/a"), ("http://s/", "http://s/a"), ("http://s/a", "http://s/b"), ("http://s/b", "http://s/")]
    assert rows(failed) == [("http://s/gone",)]
    assert rows(crawl.closure_of_snapshot(seeds, pages, rules, invalid)) == rows(visited)
    assert [x.count() for x in crawl.crawl(seeds.limit(0), crawl.snapshot_fetcher(pages), rules, invalid)] == [0, 0, 0]


def test_crawl_of_all_sites(spark, rows):
    from pyspark.sql import functions as F

    from linkloom.plans import catalog

    d = "/root/testdata/sf0.001"
    reached = {r["url"] for r in catalog.crawl_closure(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet")
    found = crawl.lk.in_domain(crawl.lk.resolved(crawl.snapshot_fetcher(pages)(spark.createDataFrame([(u,) for u in sorted(reached)], "url string")).select("url", F.col("url").alias("page_url"), "html"), "url", "page_url"))
    admitted = crawl.lk.admitted(found.select(F.col("page").alias("src"), F.col("target").alias("dst")), spark.read.parquet(f"{d}/invalid.parquet"), catalog.robots_rules(spark, d))
    wanted = {(r["src"], r["dst"]) for r in admitted.collect() if r["dst"] in reached}
    got = {(r["src"], r["dst"]) for r in catalog.crawl_edges(spark, d).collect()}
    assert got == wanted
    assert len({u.split("/")[2] for u, _ in got}) > 1


def test_reports_and_sinks(spark, rows, tmp_path):
    report = spark.createDataFrame([("UrlProcessed", 1, "u", None), ("UrlProcessed", 1, "u", None), ("UrlProcessed", 2, None, "m"), ("New", 3, "v", None), (None, 4, "w", None)], "status string, seq long, url string, message string")
    assert rows(reports.routing(report)) == [("other", "New", 1, 1, 3, 3), ("urls", "UrlProcessed", 2, 1, 1, 2)]
    v, e = frame(spark, "ab", [("a", "b"), ("a", "b")])
    docs = spark.createDataFrame([("a", 0.5, 3.0), (None, 1.0, 1.0)], "url string, pagerank double, download_ms double")
    assert rows(reports.document_report(docs, v, e)) == [("a", 0.5, 3.0, 0, 2, [], ["b", "b"]), ("b", None, None, 2, 0, ["a", "a"], [])]
    sinks.save_ranked(graph.distribution(v, e, "in"), "degree", str(tmp_path / "in"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "in")).collect()] == ["b 2", "a 0"]
    pages = spark.createDataFrame([(1, "http://s:8/x", "h"), (2, None, "i")], "page_id long, url string, html string")
    sinks.save_pages(pages, str(tmp_path / "pages"))
    assert rows(spark.read.parquet(str(tmp_path / "pages")), "directory", "path", "html") == [("s", "x/index.html", "h")]
    assert rows(sinks.page_paths(pages)) == [(1, "s", "x/index.html")]


def test_written_tables_can_be_dropped(spark):
    import os

    from linkloom import session

    df = session.written(spark.range(5).toDF("x"))
    path = session.WRITTEN[-1].removeprefix("file:")
    assert df.count() == 5
    assert os.path.isdir(path)
    kept = session.WRITTEN[:-1]
    session.WRITTEN[:] = session.WRITTEN[-1:]
    session.drop_written(spark)
    session.WRITTEN[:] = kept
    assert not os.path.isdir(path)


def two_sites(spark):
    """Two sites in one component, a vertex without links, edges that repeat or leave."""
    rng = random.Random(5)
    v = [f"http://{s}/{k}" for s in "st" for k in range(9)] + ["http://u/0"]
    e = [(rng.choice(v[:-1]), rng.choice([*v[:-1], "http://u/gone"])) for _ in range(30)] + [(v[0], v[1])] * 2
    return v, *frame(spark, v, e)


def many_edges(spark):
    """500,200 edges in components of two vertices."""
    edges = spark.range(500_200).selectExpr("concat('http://s/', id) AS src", "concat('http://s/', id + 1 - 2 * (id % 2)) AS dst")
    return edges.select(edges.src.alias("url")), edges


@pytest.fixture
def no_levels(monkeypatch):
    def fail(*_):
        raise AssertionError("level by level")

    monkeypatch.setattr(paths, "_levels", fail)


def test_half_a_million_edges_are_searched(spark, no_levels):
    v, e = many_edges(spark)
    found = paths.all_pairs(e, v)
    assert found.groupBy("dist").count().orderBy("dist").collect() == [(1, 500_200), (2, 500_200)]


def test_pairs_by_both_plans(spark, rows):
    v, vertices, edges = two_sites(spark)
    some = spark.createDataFrame([(v[3],), (v[12],), ("http://u/gone",)], "url string")
    assert rows(paths.all_pairs(edges, vertices)) == rows(paths.all_pairs(edges, vertices, limit=0))
    assert rows(paths.all_pairs(edges, vertices, sources=some, deepest=3)) == rows(paths.all_pairs(edges, vertices, sources=some, deepest=3, limit=0))


def test_reach_adds_up_in_the_search(spark, rows, no_levels):
    v, e = many_edges(spark)
    reached = paths.reach(e, v)
    assert reached.groupBy("pairs", "total", "most").count().collect() == [(2, 3, 2, 500_200)]
    assert paths.eccentricity_of(reached, v).groupBy("eccentricity").count().collect() == [(2, 500_200)]


def test_reach_by_both_plans(spark, rows):
    _, vertices, edges = two_sites(spark)
    reached, far = paths.reach(edges, vertices), paths.all_pairs(edges, vertices, limit=0)
    assert rows(reached) == rows(paths.reach(edges, vertices, limit=0))
    assert {r["src"] for r in reached.collect()} == {r["src"] for r in far.collect()}
    assert rows(paths.eccentricity_of(reached, vertices)) == rows(paths.eccentricity(far, vertices))


def test_summary_of_many_edges(spark, rows, no_levels):
    v, e = many_edges(spark)
    assert rows(paths.summary_of(paths.reach(e, v), v)) == [(1_000_400, 1.5, 2, 2)]
    _, vertices, edges = two_sites(spark)
    assert rows(paths.summary_of(paths.reach(edges, vertices), vertices)) == rows(paths.distance_summary(paths.all_pairs(edges, vertices), vertices))


def test_path_texts_by_both_plans(spark, rows):
    from pyspark.sql import functions as F

    _, vertices, edges = two_sites(spark)
    far = paths.shortest(edges, vertices, limit=0)
    assert rows(paths.shortest(edges, vertices)) == rows(far)
    assert rows(paths.shortest_texts(edges, vertices)) == rows(far.withColumn("path", F.concat_ws(" ", "path"))) == rows(paths.shortest_texts(edges, vertices, limit=0))


def test_paths_of_many_edges(spark, no_levels):
    v, e = many_edges(spark)
    assert paths.shortest_texts(e, v).selectExpr("if(src = dst, path = '', path = dst) AS good").groupBy("good").count().collect() == [(True, 1_000_400)]


def test_reports_are_not_joined(spark, rows):
    _, vertices, edges = two_sites(spark)
    found, ordered = paths.path_reports(edges, vertices)
    got = [tuple(r) for r in found.collect()]
    joined = paths.path_report(paths.shortest(edges, vertices), vertices)
    assert ordered and got == sorted(got) == rows(joined) == rows(paths.path_reports(edges, vertices, limit=0)[0])
    assert len(got) == 9 * 9 + 9 * 9 + 1
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert "strategy=merge" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_saved_reports_keep_their_order(spark, tmp_path):
    """Reports in order are written without a sort, packed, and read back line by line."""
    _, vertices, edges = two_sites(spark)
    found, ordered = paths.path_reports(edges, vertices)
    sinks.save_reports(found, str(tmp_path / "a"), ordered, "gzip")
    sinks.save_reports(found, str(tmp_path / "b"))
    files = sorted((tmp_path / "a").glob("part-*.gz"))
    assert files
    lines = [x for f in files for x in spark.read.text(str(f)).toPandas()["value"]]
    wanted = [x for f in sorted((tmp_path / "b").glob("part-*")) for x in spark.read.text(str(f)).toPandas()["value"]]
    assert lines == wanted


def test_reports_across_sites(spark, rows):
    """Every ordered pair of vertices has a report, of different sites and without a site too."""
    v, vertices, edges = two_sites(spark)
    vertices = vertices.union(spark.createDataFrame([("no site",)], "url string"))
    found, ordered = paths.path_reports(edges, vertices, across=True)
    got = [tuple(r) for r in found.collect()]
    ways = {(r["src"], r["dst"]): r["path"] for r in paths.shortest(edges, vertices).collect()}
    every = sorted([*v, "no site"])
    assert any(a.split("/")[2] != b.split("/")[2] for a, b in ways)
    assert ordered and got == [(a, b, "\n".join([f"Path from {a} to {b}", *ways.get((a, b), []), ""])) for a in every for b in every]
    assert got == rows(paths.path_reports(edges, vertices, limit=0, across=True)[0])


def test_path_texts_are_packed(spark, rows, tmp_path):
    """Each path comes right after one that it prolongs or that shares the beginning, and the result is written by zstd, without a change of the caller's session."""
    v = [f"http://s/{k:02}" for k in range(40)]
    vertices, edges = frame(spark, v, [*zip(v, v[1:], strict=False), (v[0], v[20]), (v[5], v[1])])
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    found = paths.shortest_texts(edges, vertices)
    ways = [(r["src"], r["path"].split()) for r in found.collect() if r["src"] == v[0]]
    kept = {tuple(p) for _, p in ways}
    assert len(ways) == 39
    assert all(len(b) == 1 or tuple(b[:-1]) in kept and a[: len(b) - 1] == b[:-1] for (_, a), (_, b) in zip(ways, ways[1:], strict=False))
    found.write.parquet(str(tmp_path / "x"))
    assert list((tmp_path / "x").glob("part-*.zstd.parquet")) and spark.conf.get("spark.sql.parquet.compression.codec") == codec
    assert rows(spark.read.parquet(str(tmp_path / "x"))) == rows(found) == rows(paths.shortest_texts(edges, vertices, limit=0))


def test_reports_are_packed(spark, rows, tmp_path):
    _, vertices, edges = two_sites(spark)
    found, _ = paths.path_reports(edges, vertices, across=True)
    found.write.parquet(str(tmp_path / "x"))
    assert list((tmp_path / "x").glob("part-*.zstd.parquet"))
    assert rows(spark.read.parquet(str(tmp_path / "x"))) == rows(found)


def test_reports_by_path(spark, rows):
    """The same reports, those of a source by their paths: each path after one that it prolongs, pairs without a path last."""
    _, vertices, edges = two_sites(spark)
    found, ordered = paths.path_reports(edges, vertices, by_path=True)
    got = [tuple(r) for r in found.collect()]
    assert ordered and [r[0] for r in got] == sorted(r[0] for r in got)
    assert sorted(got) == rows(paths.path_reports(edges, vertices)[0])
    for s in {r[0] for r in got}:
        ways = [r[2].split("\n")[1:-1] for r in got if r[0] == s and r[0] != r[1]]
        ways = [w for k, w in enumerate(ways) if w or any(ways[k:])]
        assert all(ways) and ways == sorted(ways)


def test_lines_of_reports(spark, rows):
    """Headings are not shuffled, those that can be read in two ways are added up, and without sure headings all lines are."""
    v = ["a", "a to b", "b", "b to c", "c"]
    vertices, edges = frame(spark, v, [("a", "b"), ("b", "c"), ("c", "a to b")])
    reports = [r["report"] for r in paths.path_reports(edges, vertices, across=True)[0].collect()]
    lines = spark.createDataFrame([(x,) for r in reports for x in r.split("\n")], "value string")
    got = sinks.report_lines(lines, paths.headings_alone(vertices))
    assert rows(got) == rows(sinks.report_lines(lines, False))
    assert ("Path from a to b to c", 2) in rows(got) and ("Path from a to c", 1) in rows(got)
    assert "Union" in got._jdf.queryExecution().executedPlan().toString()
    for odd in ("Path from a to b", "x\ny", "x\ry"):
        assert not paths.headings_alone(vertices.union(spark.createDataFrame([(odd,)], "url string")))
