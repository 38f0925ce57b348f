"""One site from seed to reports: crawl, graph analysis, topics, filter, and their files."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.operators import crawl, graph, pagerank, paths, plsa, robots, terms
from linkloom.session import written
from linkloom.sources import pages as pg
from linkloom.sources import sinks


@dataclass(frozen=True)
class Settings:
    """What a user sets, with its defaults."""

    domain: str
    concurrency: int = 8
    topics: int = 3
    iterations: int = 1
    convergence: float | None = None  # given, iterations end early
    filter_factor: float = 2.0
    print_paths: bool = False
    match: str = "base_of"
    leave_noindex: bool = False  # leave pages out of the term counts that forbid indexing


@dataclass
class SiteAnalysis:
    """Frames of one site; each step is a function of the ones before, nothing is kept between sites."""

    settings: Settings
    pages: DataFrame = field(repr=False)
    vertices: DataFrame = field(repr=False)
    edges: DataFrame = field(repr=False)
    failed: DataFrame = field(repr=False)
    crawl_seconds: float = 0.0

    def degrees(self) -> DataFrame:
        return graph.degrees(self.vertices, self.edges)

    def ranks(self, **options) -> DataFrame:
        return pagerank.pagerank(self.vertices, self.edges, **options)

    def pairs(self) -> DataFrame:
        return paths.all_pairs(self.edges, self.vertices)

    def summary(self) -> dict:
        """Counts, mean degrees, mean rank, distances, and pages a second of the crawl."""
        out = graph.summary(self.vertices, self.edges).first().asDict()
        out |= self.ranks().agg(F.avg("pagerank").alias("mean_pagerank")).first().asDict()
        out |= paths.distance_summary(self.pairs(), self.vertices).first().asDict()
        return out | {"crawl_seconds": self.crawl_seconds, "pages_a_second": out["vertices"] / self.crawl_seconds if self.crawl_seconds else None}

    def term_counts(self) -> DataFrame:
        use = self.pages.where(~text.has_noindex(F.col("html"))) if self.settings.leave_noindex else self.pages
        return terms.term_counts(use, "url", F.col("html"), html=True)

    def topics(self) -> plsa.Model:
        s = self.settings
        return plsa.fit(self.term_counts(), s.topics, s.iterations, tol=s.convergence)

    def filtered(self, model: plsa.Model, factor: float | None = None) -> DataFrame:
        """Documents by topic; may be asked again with another factor without fitting again."""
        return plsa.topic_filter(model.documents, model.topics, self.settings.filter_factor if factor is None else factor)

    def save(self, folder: str) -> None:
        """Pages, ranked lists and, if set, all paths, under a folder named as the site."""
        name = "".join(c for c in self.settings.domain if c not in '\\/:*?"<>|' and c >= " ")
        base = f"{folder}/{name}"
        sinks.save_pages(self.pages, f"{base}/pages")
        for kind in ("in", "out"):
            sinks.save_ranked(graph.distribution(self.vertices, self.edges, kind), "degree", f"{base}/{kind}Distribution")
        sinks.save_ranked(graph.ranked(self.ranks(), "pagerank"), "pagerank", f"{base}/pagerank")
        if self.settings.print_paths:
            sinks.save_reports(paths.path_report(paths.shortest(self.edges, self.vertices), self.vertices), f"{base}/paths")


def analyse(spark: SparkSession, settings: Settings, fetch: crawl.Fetcher | None = None) -> SiteAnalysis:
    """Crawls the site of ``settings.domain`` from its front page. ``fetch`` maps (url) to (url, html); without it pages come over HTTP."""
    get = fetch or (lambda wanted: pg.fetch(wanted, at_once=settings.concurrency).select("url", "html"))
    seed = spark.createDataFrame([(settings.domain,)], "url string").select(urls.canonical(F.col("url")).alias("url"))
    began = time.perf_counter()
    file = get(seed.select(F.concat(urls.root_of(F.col("url")), F.lit("/robots.txt")).alias("url")))
    rules = written(robots.rules(file.select(urls.host_of(F.col("url")).alias("host"), F.col("html").alias("body"))))
    stored: list[DataFrame] = []

    def keep(wanted: DataFrame) -> DataFrame:
        stored.append(written(get(wanted).select("url", "html")))
        return stored[-1]

    none = spark.createDataFrame([], "url string")
    visited, edges, failed = crawl.crawl(seed, keep, rules, none, settings.match)
    pages = stored[0]
    for more in stored[1:]:
        pages = pages.unionByName(more)
    v = written(visited.select("url"))
    e = written(graph.prune_edges(edges, v))
    return SiteAnalysis(settings, pages.where("html is not null"), v, e, written(failed), time.perf_counter() - began)
