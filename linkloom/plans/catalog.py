"""All queries of the library by name, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.operators import crawl, graph, links, pagerank, paths, plsa, reports, robots, terms
from linkloom.plans import sql
from linkloom.session import spread, written
from linkloom.sources import pages as pg
from linkloom.sources import sinks
from linkloom.streaming import pages as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOPICS, PLACES = 3, 6


def query(text_: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text_ is not None:
            SQL[f.__name__] = text_
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- sources and links


@query(f"""WITH {sql.FIRST_FETCH} SELECT u.url, f.page_id, f.page_id IS NOT NULL AS fetched
    FROM (SELECT DISTINCT {sql.canon("url")} AS url FROM documents_v WHERE url IS NOT NULL) u LEFT JOIN (SELECT url, page_id FROM first_fetch WHERE html <> '') f ON u.url = f.url""")
def fetch_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every known address with its stored fetch."""
    return pg.fetch_snapshot(table(spark, d, "documents_v"), table(spark, d, "pages"))


@query(f"WITH RECURSIVE {sql.RULES} SELECT host, prefix FROM rules")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return robots.rules(table(spark, d, "robots"))


@query(f"SELECT page_id, regexp_replace({sql.host('url')}, '[\\\\/:*?\"<>|]', '', 'g') AS directory, {sql.file_path('url')} AS path FROM pages WHERE url IS NOT NULL")
def page_file_path(spark: SparkSession, d: str) -> DataFrame:
    return sinks.page_paths(table(spark, d, "pages"))


@query(f"SELECT page_id, (k - 1)::INTEGER AS pos, list_extract(h, k) AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, {sql.lit(text.HREF)}, 1) AS h FROM pages WHERE html IS NOT NULL))")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return links.extract(table(spark, d, "pages"))


LINKS = f"""hrefs AS (SELECT page_id, {sql.canon("url")} AS page, unnest(regexp_extract_all(html, {sql.lit(text.HREF)}, 1)) AS href FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
    links AS (SELECT page_id, page, href, {sql.resolve("href", "page")} AS target FROM hrefs)"""


@query(f"WITH {LINKS} SELECT page, href, target, count(*) AS n FROM links GROUP BY 1, 2, 3")
def normalize_links(spark: SparkSession, d: str) -> DataFrame:
    return links.resolved(table(spark, d, "pages")).groupBy("page", "href", "target").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT page AS src, target AS dst, count(*) AS n FROM links WHERE target IS NOT NULL AND starts_with(target, {sql.root('page')} || '/') GROUP BY 1, 2")
def in_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return links.in_domain(links.resolved(table(spark, d, "pages"))).groupBy(F.col("page").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {sql.canon('url')} AS url, {sql.host('url')} AS host FROM pages")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"), urls.host_of(F.col("url")).alias("host"))


@query(f"""WITH RECURSIVE {sql.RULES}, {sql.BAD}, {LINKS} SELECT page, target, disposition, count(*) AS n FROM (SELECT page, target, CASE WHEN regexp_matches({sql.cut("href")}, '(?i)^file:') THEN 'file'
    WHEN target IS NULL THEN 'malformed' WHEN NOT starts_with(target, {sql.root("page")} || '/') THEN 'external' WHEN target IN (SELECT url FROM bad) THEN 'invalid'
    WHEN {sql.forbidden("target")} THEN 'disallowed' ELSE 'admitted' END AS disposition FROM links) GROUP BY 1, 2, 3""")
def link_disposition(spark: SparkSession, d: str) -> DataFrame:
    """Links of all pages with the reason why they are followed or not."""
    found = links.disposition(links.resolved(table(spark, d, "pages")), table(spark, d, "invalid"), robots_rules(spark, d))
    return found.groupBy("page", "target", "disposition").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {sql.RULES}, {sql.BAD}, {sql.ALL_EDGES} SELECT src, dst, count(*) AS n FROM every WHERE dst NOT IN (SELECT url FROM bad) AND NOT {sql.forbidden('dst')} GROUP BY 1, 2")
def admit_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.multiplicity(links.admitted(table(spark, d, "edges"), table(spark, d, "invalid"), robots_rules(spark, d)))


@query(f"SELECT page_id, coalesce(regexp_matches(html, '(?is)<meta[^>]*name\\s*=\\s*[\"'']?robots[^>]*>') AND len(list_filter(regexp_extract_all(html, '(?is)<meta[^>]*>'), lambda m: regexp_matches(m, '(?is)\\bname\\s*=\\s*[\"'']?robots\\b') AND regexp_matches(m, '(?is)\\bcontent\\s*=\\s*[\"'']?[^\"''>]*\\bnoindex\\b'))) > 0, false) AS noindex FROM pages")
def noindex_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.has_noindex(F.col("html")).alias("noindex"))


# ---------------------------------------------------------------- text and terms


@query(f"SELECT page_id, {sql.html_to_text('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, coalesce({sql.tokens('text')}, []) AS t FROM documents)")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Number of terms, of different ones, and a digest of all terms of each text."""
    t = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("terms"), F.md5(F.concat_ws(" ", "t")).alias("digest"))


def page_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(pg.first_fetch(table(spark, d, "pages")), "url", F.col("html"), html=True)


@query(f"WITH {sql.PAGE_TERMS} SELECT term, url, n FROM page_terms")
def term_doc_counts(spark: SparkSession, d: str) -> DataFrame:
    return page_terms(spark, d)


TOP = 40


@query(f"WITH {sql.PAGE_TERMS}, top AS (SELECT term FROM page_terms GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT {TOP}) SELECT t.term, u.url, coalesce(p.n, 0) AS n FROM top t CROSS JOIN (SELECT DISTINCT url FROM page_terms) u LEFT JOIN page_terms p ON p.term = t.term AND p.url = u.url")
def term_doc_top(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the counts of the most frequent terms on every page, 0 where absent. ``term_doc_dense`` has all terms."""
    counts = written(page_terms(spark, d))
    top = counts.groupBy("term").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "term").limit(TOP)
    return terms.dense(counts, top)


@query(f"WITH {sql.PAGE_TERMS} SELECT url, (SELECT count(DISTINCT term) FROM page_terms) AS length, string_agg(term || ':' || n, ' ' ORDER BY term) AS entries FROM page_terms GROUP BY 1")
def term_doc_dense(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of all terms and all pages, one vector a page: its length, and the terms and counts that are not 0 (no term holds a blank or a colon)."""
    m = terms.matrix(written(page_terms(spark, d)))
    return m.select("url", "length", F.array_join(F.zip_with("terms", "n", lambda t, n: F.concat_ws(":", t, n.cast("string"))), " ").alias("entries"))


@query(f"WITH {sql.PAGE_TERMS} SELECT count(DISTINCT term) AS terms, count(DISTINCT url) AS documents, count(*) AS pairs, sum(n)::BIGINT AS tokens FROM page_terms")
def vocabulary_stats(spark: SparkSession, d: str) -> DataFrame:
    return terms.vocabulary(page_terms(spark, d))


# ---------------------------------------------------------------- graph


def site_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fetched documents and the links among them."""
    v = written(graph.prune_documents(table(spark, d, "documents_v"), table(spark, d, "invalid")))
    return v, written(graph.prune_edges(table(spark, d, "edges"), v))


@query(f"WITH {sql.VERTICES} SELECT url FROM v")
def prune_documents(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune_documents(table(spark, d, "documents_v"), table(spark, d, "invalid"))


@query(f"WITH {sql.GRAPH} SELECT src, dst FROM e")
def prune_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune_edges(table(spark, d, "edges"), prune_documents(spark, d))


@query(f"WITH {sql.ALL_EDGES} SELECT src, dst, count(*) AS n FROM every GROUP BY 1, 2")
def edge_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return graph.multiplicity(graph.canonical_edges(table(spark, d, "edges")))


@query(f"WITH {sql.DEGREES} SELECT url, indegree, outdegree FROM deg")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*site_graph(spark, d))


@query(f"WITH {sql.DEGREES} SELECT count(*) AS vertices, sum(indegree)::BIGINT AS total_in, sum(outdegree)::BIGINT AS total_out, round(avg(indegree), {PLACES}) AS mean_in, round(avg(outdegree), {PLACES}) AS mean_out FROM deg")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(*site_graph(spark, d)).withColumns({k: F.round(k, PLACES) for k in ("mean_in", "mean_out")})


@query(f"WITH {sql.DEGREES} {sql.ranked('deg', 'indegree', 'url, indegree AS degree')}")
def in_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.distribution(*site_graph(spark, d), "in")


@query(f"WITH {sql.DEGREES} {sql.ranked('deg', 'outdegree', 'url, outdegree AS degree')}")
def out_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.distribution(*site_graph(spark, d), "out")


@query(f"WITH {sql.pagerank(10)} SELECT url, round(pagerank, 9) AS pagerank FROM r10")
def pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(*site_graph(spark, d)).select("url", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH {sql.pagerank(10)}, r AS (SELECT url, round(pagerank, 9) AS pagerank FROM r10) {sql.ranked('r', 'pagerank', 'url, pagerank')}")
def pagerank_ranked(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranked(pagerank_10(spark, d), "pagerank")


@query(f"WITH {sql.pagerank(10)} SELECT round(avg(pagerank), 9) AS mean_pagerank FROM r10")
def pagerank_mean(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(*site_graph(spark, d)).agg(F.round(F.avg("pagerank"), 9).alias("mean_pagerank"))


@query(sql.pagerank_until(100, 1e-4))
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """Until no rank changes by more than 0.0001 of the mean rank."""
    v, e = site_graph(spark, d)
    return pagerank.pagerank(v, e, steps=100, tol=1e-4 / max(1, v.count())).select("url", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH RECURSIVE {sql.NEXT} SELECT src, dst, dist, next FROM hop")
def all_pairs_distance(spark: SparkSession, d: str) -> DataFrame:
    v, e = site_graph(spark, d)
    return paths.all_pairs(e, v)


@query(f"WITH RECURSIVE {sql.PAIRS}, ends AS (SELECT src, min(dst) AS dst FROM d GROUP BY 1) SELECT p.src, p.dst, p.dist FROM pairs p JOIN (SELECT src FROM ends ORDER BY src LIMIT 1) s ON p.src = s.src")
def point_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances from one vertex: the first that has links."""
    v, e = site_graph(spark, d)
    first = e.agg(F.min("src").alias("url"))
    return paths.all_pairs(e, v, sources=first).select("src", "dst", "dist")


@query(f"WITH RECURSIVE {sql.PATHS} SELECT src, dst, dist, array_to_string(path, ' ') AS path FROM found")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    v, e = site_graph(spark, d)
    return paths.shortest_texts(e, v)


def reports_sql(pairs: str) -> str:
    return f"WITH RECURSIVE {sql.PATHS} SELECT a.url AS src, b.url AS dst, array_to_string(list_concat(['Path from ' || a.url || ' to ' || b.url], coalesce(f.path, []), ['']), chr(10)) AS report FROM v a {pairs} LEFT JOIN found f ON f.src = a.url AND f.dst = b.url"


@query(reports_sql("CROSS JOIN v b"))
def path_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports of all ordered pairs, of different sites too."""
    v, e = site_graph(spark, d)
    return paths.path_reports(e, v, across=True)[0]


SITE_REPORTS = reports_sql(f"JOIN v b ON {sql.host('a.url')} = {sql.host('b.url')}")


@query(f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(report, chr(10))) AS line FROM ({SITE_REPORTS})) GROUP BY 1")
def paths_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the file of the paths of each site, with their number."""
    from linkloom.session import shared_path

    path = shared_path(spark, "paths")
    v, e = site_graph(spark, d)
    found, ordered = paths.path_reports(e, v, by_path=True)
    sinks.save_reports(found, path, ordered, "gzip")
    return sinks.report_lines(spark.read.text(path), paths.headings_alone(v))


@query(f"WITH RECURSIVE {sql.PAIRS} SELECT v.url, coalesce(max(dist), 0)::INTEGER AS eccentricity FROM v LEFT JOIN pairs p ON v.url = p.src GROUP BY 1")
def eccentricity(spark: SparkSession, d: str) -> DataFrame:
    v, e = site_graph(spark, d)
    return paths.eccentricity_of(paths.reach(e, v), v)


@query(f"WITH RECURSIVE {sql.PAIRS}, ecc AS (SELECT v.url, coalesce(max(dist), 0) AS k FROM v LEFT JOIN pairs p ON v.url = p.src GROUP BY 1) SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT round(avg(dist), {PLACES}) FROM pairs) AS mean_distance, max(k)::INTEGER AS diameter, min(nullif(k, 0))::INTEGER AS radius FROM ecc")
def graph_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    v, e = site_graph(spark, d)
    return paths.summary_of(paths.reach(e, v), v).withColumn("mean_distance", F.round("mean_distance", PLACES))


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page of each site, by address."""
    stored = pg.first_fetch(pages.where("html is not null and html <> ''"))
    return stored.groupBy(urls.host_of(F.col("url"))).agg(F.min("url").alias("url")).select("url")


CLOSURE = f"""{sql.RULES}, {sql.BAD}, {sql.FIRST_FETCH}, stored AS (SELECT url, page_id, html FROM (SELECT {sql.canon("url")} AS url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages WHERE url IS NOT NULL AND html <> '' GROUP BY 1)),
    seeds AS (SELECT min(url) AS url FROM stored GROUP BY {sql.host("url")}),
    found AS (SELECT url AS page, unnest(regexp_extract_all(html, {sql.lit(text.HREF)}, 1)) AS href FROM stored), l AS (SELECT page AS src, {sql.resolve("href", "page")} AS dst FROM found),
    ok AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND starts_with(dst, {sql.root("src")} || '/') AND dst NOT IN (SELECT url FROM bad) AND NOT {sql.forbidden("dst")} AND dst IN (SELECT url FROM stored)),
    walk(url, depth) USING KEY (url) AS (SELECT url, 0 FROM seeds UNION SELECT ok.dst, min(w.depth + 1) FROM walk w JOIN ok ON ok.src = w.url WHERE ok.dst NOT IN (SELECT url FROM recurring.walk) GROUP BY 1)"""


@query(f"WITH RECURSIVE {CLOSURE} SELECT url, depth::INTEGER AS depth FROM walk")
def crawl_closure(spark: SparkSession, d: str) -> DataFrame:
    """From the first page of each site along admitted links, over the stored pages."""
    pages = table(spark, d, "pages")
    return crawl.closure_of_snapshot(first_pages(pages), pages, robots_rules(spark, d), table(spark, d, "invalid"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT count(*) AS pages, count(DISTINCT {sql.host('url')}) AS sites, max(depth)::INTEGER AS deepest FROM walk")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: pages reached, their sites, and the greatest depth."""
    return crawl_closure(spark, d).agg(F.count("*").alias("pages"), F.countDistinct(urls.host_of(F.col("url"))).alias("sites"), F.max("depth").alias("deepest"))


@query(f"""WITH RECURSIVE {CLOSURE} SELECT src, dst, count(*) AS n FROM l WHERE src IN (SELECT url FROM walk) AND dst IN (SELECT url FROM walk) AND starts_with(dst, {sql.root("src")} || '/')
    AND dst NOT IN (SELECT url FROM bad) AND NOT {sql.forbidden("dst")} GROUP BY 1, 2""")
def crawl_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links that a crawl finds, by rounds of fetching, from the first page of each site."""
    pages = table(spark, d, "pages")
    _, edges, _ = crawl.crawl(first_pages(pages), crawl.snapshot_fetcher(pages), robots_rules(spark, d), table(spark, d, "invalid"))
    return graph.multiplicity(edges)


# ---------------------------------------------------------------- topics


def model(steps: str = "", topics: int = TOPICS) -> Callable[[SparkSession, str], plsa.Model]:
    def get(spark: SparkSession, d: str) -> plsa.Model:
        counts = written(page_terms(spark, d))
        m = plsa.start(counts, topics)
        for s in steps:
            m = plsa.step_terms(counts, m) if s == "t" else plsa.step_documents(counts, m)
        return m

    return get


def rounded(df: DataFrame, column: str = "p") -> DataFrame:
    return df.withColumn(column, F.round(column, PLACES))


P0, PT, P1 = sql.Plsa(TOPICS), sql.Plsa(TOPICS).terms(), sql.Plsa(TOPICS).terms().documents()


def plsa_sql(p: sql.Plsa, side: str, prefix: str = "") -> str:
    key = "term" if side == "terms" else "url"
    return f"WITH {p.cte} SELECT {key} AS key, topic, round(p, {PLACES}) AS p FROM ({p.rows(side)})"


@query(f"WITH {P0.cte} SELECT 'term' AS side, term AS key, topic, round(p, {PLACES}) AS p FROM ({P0.rows('terms')}) UNION ALL SELECT 'url', url, topic, round(p, {PLACES}) FROM ({P0.rows('documents')})")
def plsa_init(spark: SparkSession, d: str) -> DataFrame:
    m = model()(spark, d)
    sides = [plsa.by_topic(t, k).select(F.lit(k).alias("side"), F.col(k).alias("key"), "topic", "p") for t, k in ((m.terms, "term"), (m.documents, "url"))]
    return rounded(sides[0].unionByName(sides[1]))


@query(plsa_sql(PT, "terms"))
def plsa_step_terms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plsa.by_topic(model("t")(spark, d).terms, "term").withColumnRenamed("term", "key"))


@query(plsa_sql(P1, "documents"))
def plsa_step_docs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plsa.by_topic(model("td")(spark, d).documents, "url").withColumnRenamed("url", "key"))


@query(f"WITH {P1.cte} SELECT 'term' AS side, term AS key, topic, round(p, {PLACES}) AS p FROM ({P1.rows('terms')}) UNION ALL SELECT 'url', url, topic, round(p, {PLACES}) FROM ({P1.rows('documents')})")
def plsa_k3_i1(spark: SparkSession, d: str) -> DataFrame:
    m = plsa.fit(page_terms(spark, d), TOPICS, 1)
    sides = [plsa.by_topic(t, k).select(F.lit(k).alias("side"), F.col(k).alias("key"), "topic", "p") for t, k in ((m.terms, "term"), (m.documents, "url"))]
    return rounded(sides[0].unionByName(sides[1]))


@query(f"WITH {P1.cte} SELECT term, round({' + '.join(f'p{z}' for z in P1.zs)}, {PLACES}) AS total FROM {P1.w}")
def plsa_row_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plsa.row_sums(model("td")(spark, d).terms, "term"), "total")


def _listing(side: str, topic_first: bool) -> tuple[str, Query]:
    key = "term" if side == "terms" else "url"
    name = f"'Topic ' || topic || ',' || {key}" if topic_first else f"{key} || ',Topic ' || topic"
    text_ = f"WITH {P1.cte} SELECT topic, {key}, '[' || {name} || ']=' || printf('%.6f', p) AS line FROM ({P1.rows(side)})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        m = model("td")(spark, d)
        return plsa.report_lines(m.terms if side == "terms" else m.documents, key, topic_first)

    return text_, run


for _name, _side, _first in (("plsa_terms_by_topic", "terms", False), ("plsa_topic_by_terms", "terms", True), ("plsa_topic_by_document", "documents", True), ("plsa_document_by_topic", "documents", False)):
    SQL[_name], QUERIES[_name] = _listing(_side, _first)


@query(f"WITH {P1.cte}, r AS ({P1.rows('documents')}), b AS (SELECT url, max(p) AS best FROM r GROUP BY 1) SELECT topic, url, round(p, {PLACES}) AS p FROM r JOIN b USING (url) WHERE p = best AND best >= 1.2::DOUBLE / {TOPICS}")
def plsa_topic_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plsa.topic_filter(model("td")(spark, d).documents, TOPICS, 1.2))


@query()
def plsa_converged(spark: SparkSession, d: str) -> DataFrame:
    """All topics at once, until the log-likelihood grows by less than a thousandth."""
    m = plsa.fit(page_terms(spark, d), TOPICS, 10, "simultaneous", 1e-3)
    return rounded(plsa.by_topic(m.documents, "url"))


# ---------------------------------------------------------------- reports


@query(f"""WITH {sql.DEGREES}, known AS (SELECT {sql.canon("url")} AS url, max(pagerank) AS pagerank, max(download_ms) AS download_ms FROM documents_v WHERE url IS NOT NULL GROUP BY 1)
    SELECT deg.url, pagerank, download_ms, indegree, outdegree, coalesce(i.l, '') AS inlinks, coalesce(o.l, '') AS outlinks FROM deg LEFT JOIN known ON deg.url = known.url
    LEFT JOIN (SELECT dst AS url, string_agg(src, ' ' ORDER BY src) AS l FROM e GROUP BY 1) i ON deg.url = i.url LEFT JOIN (SELECT src AS url, string_agg(dst, ' ' ORDER BY dst) AS l FROM e GROUP BY 1) o ON deg.url = o.url""")
def document_report(spark: SparkSession, d: str) -> DataFrame:
    found = reports.document_report(table(spark, d, "documents_v"), *site_graph(spark, d))
    return found.withColumns({k: F.concat_ws(" ", k) for k in ("inlinks", "outlinks")})


@query(f"""SELECT coalesce(p.place, 'other') AS place, r.status, count(*) AS events, count(DISTINCT url) AS urls, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT DISTINCT status, seq, url, message FROM report WHERE status IS NOT NULL) r
    LEFT JOIN (VALUES {", ".join(f"({sql.lit(k)}, {sql.lit(v)})" for k, v in reports.PLACES.items())}) p(status, place) ON r.status = p.status GROUP BY 1, 2""")
def report_routing(spark: SparkSession, d: str) -> DataFrame:
    return reports.routing(table(spark, d, "report"))


# ---------------------------------------------------------------- streams (a pattern as path, as a table may be one file)


@query(SQL["in_domain_filter"])
def stream_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links inside the sites, taken as pages arrive, and counted."""
    found = streams.to_table(streams.edges(streams.read_pages(spark, f"{d}/page[s].parquet")))
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"SELECT term, url, count(*) AS n FROM (SELECT {sql.canon('url')} AS url, unnest({sql.tokens(sql.html_to_text('html'))}) AS term FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) GROUP BY 1, 2")
def stream_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all fetches of each address, kept up to date as pages arrive."""
    return streams.to_table(streams.term_counts(streams.read_pages(spark, f"{d}/page[s].parquet")), "complete")


@query("SELECT date_trunc('hour', reported_at) AS start, status, count(*) AS events FROM report WHERE status IS NOT NULL AND reported_at IS NOT NULL GROUP BY 1, 2")
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Crawl events by hour of their own time, all windows, in complete mode."""
    rows = spark.readStream.schema("status string, seq bigint, url string, message string, reported_at timestamp, arrived_at timestamp").parquet(f"{d}/repor[t].parquet")
    return streams.to_table(streams.events_by_window(rows), "complete")
