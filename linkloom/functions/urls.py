"""URL expressions. All of them are built-in column expressions, so they stay inside whole-stage code.

Nulls give null. A text that has no ``scheme://`` is returned cut, but otherwise as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/]*)(.*)$"
HEAD = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*"
CLEAN = r"^[a-z][a-z0-9+.\-]*://[a-z0-9.\-_]+/[^#?]*$"  # canonical as it stands
SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:"


def cut(url: Column) -> Column:
    """The part before the first ``#`` or ``?``."""
    return F.regexp_replace(url, r"(?s)[#?].*$", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, group)


def canonical(url: Column) -> Column:
    """Equal for addresses of the same document: cut, scheme and host in lower case, default port dropped, empty path as /."""
    u = cut(url)
    head = F.regexp_extract(u, HEAD, 0)
    tail = F.substring(u, F.length(head) + 1, F.length(u))
    bare = F.regexp_replace(F.lower(head), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.when(url.rlike("(?s)" + CLEAN), url).when(head == "", u).otherwise(F.concat(bare, F.when(tail == "", "/").otherwise(tail)))


def fenced(expression: Column) -> Column:
    """The expression as a generated column: what is asked of it later is not pushed into it, which would multiply its pattern matches. One in a select."""
    return F.explode(F.array(expression))


def host_of(url: Column) -> Column:
    """Host in lower case without user and port; null where there is none."""
    h = F.regexp_replace(F.regexp_replace(F.lower(_part(cut(url), 2)), r"^.*@", ""), r":\d*$", "")
    return F.when(h != "", h)


def root_of(page: Column) -> Column:
    """``scheme://host[:port]`` of a canonical address; null where there is none."""
    r = F.regexp_extract(page, r"^[a-z][a-z0-9+.\-]*://[^/]+", 0)
    return F.when(r != "", r)


def base_dir(url: Column) -> Column:
    """The address up to and with its last slash."""
    return F.regexp_replace(url, r"[^/]*$", "")


def is_base_of(base: Column, url: Column) -> Column:
    """Both canonical: does ``url`` lie under the directory of ``base``?"""
    return F.startswith(url, base_dir(base))


def resolve(links: DataFrame, href: str, page: str, target: str, mode: str = "domain") -> DataFrame:
    """Adds ``target``: the absolute canonical address of the link ``href`` on the canonical address ``page``; null where not usable.

    The link is cut first. mode "domain" resolves relative links against the root of the site, "page" against the
    directory of the page. An empty link gives the root (domain) or the page (page). ``//host/x`` takes the page's scheme.
    Links holding white space, ``<``, ``>``, ``"`` or a backslash are not well formed and give null, as do ``file:`` links. The steps are columns of
    their own, so that no pattern is matched twice; the last ones are fenced.
    """
    if mode not in ("domain", "page"):
        raise ValueError(f"mode {mode!r}")
    kept = links.columns
    rows = links.withColumn("_h", cut(F.col(href))).withColumn("_root", root_of(F.col(page)))
    h, root = F.col("_h"), F.col("_root")
    below = F.concat(root, F.lit("/")) if mode == "domain" else base_dir(F.col(page))
    whole = (
        F.when(root.isNull() | h.isNull() | h.rlike(r'[\s<>"\\]'), None)
        .when(h.rlike("(?i)^file:"), None)
        .when(h == "", F.concat(root, F.lit("/")) if mode == "domain" else F.col(page))
        .when(h.rlike(ABSOLUTE), h)
        .when(h.rlike(SCHEME), None)
        .when(h.startswith("//"), F.concat(F.regexp_extract(root, "^[a-z][a-z0-9+.\\-]*:", 0), h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(below, h))
    )
    return rows.select(*kept, fenced(whole).alias("_whole")).select(*kept, fenced(canonical(F.col("_whole"))).alias(target))


def file_path(url: Column) -> Column:
    """Relative path of a saved page: without scheme and host; ``index.html`` is added to a last segment without a dot."""
    p = F.regexp_replace(_part(canonical(url), 3), "^/", "")
    last = F.regexp_extract(p, r"([^/]*)$", 1)
    slash = F.when((p == "") | p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))
    return F.when(url.isNotNull(), F.when(last.contains("."), p).otherwise(F.concat(slash, F.lit("index.html"))))


def directory_name(domain: Column) -> Column:
    """Name of the folder of a site: without control characters and ``\\ / : * ? " < > |``."""
    return F.regexp_replace(domain, r'[\x00-\x1f\\/:*?"<>|]', "")
