"""The same computations as SQL text, to hold the queries against another engine."""

from __future__ import annotations

from html.entities import name2codepoint

from linkloom.functions import text as tx
from linkloom.operators.plsa import MODULUS

ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def cut(u: str) -> str:
    return f"regexp_replace({u}, '(?s)[#?].*$', '')"


def canon(u: str) -> str:
    c = cut(u)
    head = f"lower(regexp_extract({c}, '{ABSOLUTE}[^/]*'))"
    head = f"regexp_replace(regexp_replace({head}, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
    path = f"coalesce(nullif(regexp_replace({c}, '{ABSOLUTE}[^/]*', ''), ''), '/')"
    return f"(CASE WHEN regexp_matches({c}, '{ABSOLUTE}') THEN {head} || {path} ELSE {c} END)"


def host(u: str) -> str:
    h = f"lower(regexp_extract({cut(u)}, '{ABSOLUTE}([^/]*)', 1))"
    return f"nullif(regexp_replace(regexp_replace({h}, '^.*@', ''), ':[0-9]*$', ''), '')"


def root(u: str) -> str:
    return f"nullif(regexp_extract({canon(u)}, '^[a-z][a-z0-9+.-]*://[^/]+'), '')"


def base_dir(u: str) -> str:
    return f"regexp_replace({u}, '[^/]*$', '')"


def resolve(href: str, page: str) -> str:
    """Against the root of the site."""
    h, r = cut(href), root(page)
    return f"""(CASE WHEN {r} IS NULL OR {href} IS NULL OR regexp_matches({h}, '[\\s<>"\\\\]') THEN NULL
        WHEN regexp_matches({h}, '(?i)^file:') THEN NULL
        WHEN {h} = '' THEN {r} || '/'
        WHEN regexp_matches({h}, '{ABSOLUTE}') THEN {canon(h)}
        WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN starts_with({h}, '//') THEN {canon(f"(regexp_extract({r}, '^[a-z][a-z0-9+.-]*:') || {h})")}
        WHEN starts_with({h}, '/') THEN {r} || {h}
        ELSE {r} || '/' || {h} END)"""


def file_path(u: str) -> str:
    p = f"regexp_replace(regexp_replace({canon(u)}, '{ABSOLUTE}[^/]*', ''), '^/', '')"
    return f"(CASE WHEN contains(regexp_extract({p}, '[^/]*$'), '.') THEN {p} WHEN {p} = '' OR ends_with({p}, '/') THEN {p} || 'index.html' ELSE {p} || '/index.html' END)"


def html_to_text(x: str) -> str:
    """By marks: each dropped element leaves one of three marks, blanks between two marks go, then the marks go; references last, split at the ampersand."""
    x = f"replace(replace(replace({x}, chr(1), ''), chr(2), ''), chr(3), '')"
    for pattern in ("(?s)<!--.*?-->", "(?s)<!--.*$", "(?i)<!doctype[^>]*>", "(?is)<script\\b[^>]*>.*?</script\\s*>", "(?is)<style\\b[^>]*>.*?</style\\s*>", "(?is)<(script|style)\\b.*$"):
        x = f"regexp_replace({x}, '{pattern}', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?i)<p([\\s/][^>]*)?>', chr(2), 'g')"
    x = f"regexp_replace({x}, '<[A-Za-z/!?][^>]*(>|$)', chr(3), 'g')"
    marks, blank = "[\\x01\\x02\\x03]", "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
    x = f"regexp_replace({x}, '^{blank}+({marks}|$)', '\\1')"
    for _ in range(2):  # neighbours share a mark
        x = f"regexp_replace({x}, '({marks}){blank}+({marks}|$)', '\\1\\2', 'g')"
    x = f"replace(replace(replace({x}, chr(2), chr(13) || chr(10)), chr(1), ''), chr(3), '')"
    names = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in {"apos": 39, **name2codepoint}.items()) + "}"
    ref = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
    code = f"(CASE WHEN {ref} = '' THEN NULL WHEN {ref} LIKE '#x%' OR {ref} LIKE '#X%' THEN ('0x' || substr({ref}, 3))::INTEGER WHEN {ref} LIKE '#%' THEN substr({ref}, 2)::INTEGER ELSE element_at({names}, {ref})[1] END)"
    one = f"CASE WHEN i > 1 THEN CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) || substr(p, length({ref}) + 2) ELSE '&' || p END ELSE p END"
    return f"(SELECT CASE WHEN x LIKE '%&%' THEN array_to_string(list_transform(string_split(x, '&'), lambda p, i: {one}), '') ELSE x END FROM (SELECT {x} AS x))"


def tokens(x: str) -> str:
    inside = "".join("\\" + c if c in r"\[]^-&" else c for c in tx.DELIMITERS)
    return f"list_filter(regexp_split_to_array(lower(replace({x}, 'İ', 'i̇')), {lit('[' + inside + ']+')}), lambda t: t <> '')"


FIRST_FETCH = f"first_fetch AS (SELECT {canon('url')} AS url, min(page_id) AS page_id, arg_min(html, page_id) FILTER (true) AS html FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages) WHERE url IS NOT NULL GROUP BY 1)"
PAGE_TERMS = f"{FIRST_FETCH}, page_terms AS (SELECT term, url, count(*) AS n FROM (SELECT url, unnest({tokens(html_to_text('html'))}) AS term FROM first_fetch) GROUP BY 1, 2)"

BAD = f"bad AS (SELECT DISTINCT {canon('url')} AS url FROM invalid WHERE url IS NOT NULL)"
VERTICES = f"{BAD}, v AS (SELECT DISTINCT {canon('url')} AS url FROM documents_v WHERE analyzed AND url IS NOT NULL AND {canon('url')} NOT IN (SELECT url FROM bad))"
ALL_EDGES = f"every AS (SELECT {canon('src')} AS src, {canon('dst')} AS dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)"
GRAPH = f"{VERTICES}, {ALL_EDGES}, e AS (SELECT src, dst FROM every WHERE src IN (SELECT url FROM v) AND dst IN (SELECT url FROM v))"
DEGREES = f"""{GRAPH}, deg AS (SELECT v.url, coalesce(i.k, 0) AS indegree, coalesce(o.k, 0) AS outdegree FROM v
    LEFT JOIN (SELECT dst AS url, count(*) AS k FROM e GROUP BY 1) i ON v.url = i.url LEFT JOIN (SELECT src AS url, count(*) AS k FROM e GROUP BY 1) o ON v.url = o.url)"""
PAIRS = f"""{GRAPH}, d AS (SELECT DISTINCT src, dst FROM e),
    walk(src, dst, dist) USING KEY (src, dst) AS (SELECT src, dst, 1 FROM d UNION SELECT w.src, d.dst, min(w.dist + 1) FROM walk w JOIN d ON w.dst = d.src
        WHERE NOT EXISTS (SELECT 1 FROM recurring.walk k WHERE k.src = w.src AND k.dst = d.dst) GROUP BY 1, 2),
    pairs AS (SELECT src, dst, dist::INTEGER AS dist FROM walk)"""
NEXT = f"""{PAIRS}, hop AS (SELECT p.src, p.dst, p.dist, min(d.dst) AS next FROM pairs p JOIN d ON d.src = p.src LEFT JOIN pairs q ON q.src = d.dst AND q.dst = p.dst
    WHERE (p.dist = 1 AND d.dst = p.dst) OR (p.dist > 1 AND q.dist = p.dist - 1 AND d.dst <> p.dst) GROUP BY 1, 2, 3)"""
PATHS = f"""{NEXT}, trail(src, dst, dist, here, path) AS (SELECT src, dst, dist, next, [next] FROM hop WHERE src <> dst
    UNION ALL SELECT t.src, t.dst, t.dist, h.next, list_append(t.path, h.next) FROM trail t JOIN hop h ON h.src = t.here AND h.dst = t.dst WHERE t.here <> t.dst),
    found AS (SELECT src, dst, dist, path FROM trail WHERE here = dst UNION ALL SELECT src, dst, dist, CAST([] AS VARCHAR[]) FROM hop WHERE src = dst)"""

RULES = """numbered AS (SELECT row_number() OVER () AS id, lower(host) AS host, string_split(body, chr(10)) AS lines FROM robots WHERE host IS NOT NULL AND body IS NOT NULL),
    lined AS (SELECT id, host, unnest(range(1, len(lines) + 1)) AS k, lines FROM numbered),
    line AS (SELECT id, host, k, regexp_replace(lines[k], '\\s+$', '') AS t FROM lined),
    fold(id, host, k, run, prefix) AS (
        SELECT id, host, 0::BIGINT, false, NULL::VARCHAR FROM numbered
        UNION ALL SELECT f.id, f.host, f.k + 1,
            CASE WHEN f.run AND regexp_matches(l.t, '(?i)Disallow\\s*:\\s*\\S') THEN true ELSE NOT f.run AND regexp_matches(l.t, '(?i)User-agent\\s*:\\s*\\*') END,
            CASE WHEN f.run AND regexp_matches(l.t, '(?i)Disallow\\s*:\\s*\\S') THEN regexp_extract(l.t, '(?i)Disallow\\s*:\\s*(\\S.*)$', 1) END
        FROM fold f JOIN line l ON l.id = f.id AND l.k = f.k + 1),
    rules AS (SELECT DISTINCT host, prefix FROM fold WHERE prefix IS NOT NULL)"""


def path_of(u: str) -> str:
    return f"coalesce(nullif(regexp_replace({u}, '{ABSOLUTE}[^/]*', ''), ''), '/')"


def forbidden(u: str) -> str:
    return f"EXISTS (SELECT 1 FROM rules r WHERE r.host = {host(u)} AND starts_with({path_of(u)}, {base_dir('r.prefix')}))"


def ranked(source: str, value: str, columns: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {value} DESC, url) AS rank, {columns} FROM {source}"


def pagerank(steps: int) -> str:
    out = f"""{GRAPH}, outs AS (SELECT src, count(*) AS links FROM e GROUP BY 1), arcs AS (SELECT DISTINCT e.src, e.dst, 1.0::DOUBLE / links AS share FROM e JOIN outs ON e.src = outs.src),
        n AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT url, 1.0::DOUBLE / n.n AS pagerank FROM v, n)"""
    for k in range(1, steps + 1):
        out += f""", r{k} AS (SELECT v.url, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(g.got, 0) AS pagerank FROM v CROSS JOIN n
            LEFT JOIN (SELECT dst, sum(share * pagerank) AS got FROM arcs JOIN r{k - 1} r ON arcs.src = r.url GROUP BY 1) g ON v.url = g.dst)"""
    return out


def pagerank_until(steps: int, share: float) -> str:
    """Ranks of the first step whose changes are all within that share of the mean rank, or of the last."""
    every = " UNION ALL ".join(f"SELECT {k} AS k, url, pagerank FROM r{k}" for k in range(steps + 1))
    return f"""WITH {pagerank(steps)}, steps AS ({every}), moved AS (SELECT a.k, max(abs(a.pagerank - b.pagerank)) AS most FROM steps a JOIN steps b ON a.url = b.url AND b.k = a.k - 1 GROUP BY 1)
        SELECT url, round(pagerank, 9) AS pagerank FROM steps WHERE k = coalesce((SELECT min(k) FROM moved, n WHERE most <= {share} / n.n), {steps})"""


class Plsa:
    """Common table expressions of a model: counts c, then w (term, p1..pK) and d (url, p1..pK) after each step."""

    def __init__(self, topics: int, prefix: str = PAGE_TERMS, counts: str = "page_terms"):
        self.k = topics
        zs = self.zs = range(1, topics + 1)
        self.cte = f"{prefix}, c AS (SELECT term, url, n FROM {counts})"
        for name, key in (("w", "term"), ("d", "url")):
            raw = ", ".join(f"(('0x' || substr(md5({key} || '|{z}'), 1, 8))::BIGINT % {MODULUS} + 1) / {MODULUS + 1}.0::DOUBLE AS u{z}" for z in zs)
            total = " + ".join(f"u{z}" for z in zs)
            self.cte += f", {name}0 AS (SELECT {key}, " + ", ".join(f"u{z} / ({total}) AS p{z}" for z in zs) + f" FROM (SELECT {key}, {raw} FROM (SELECT DISTINCT {key} FROM c)))"
        self.w, self.d, self.n = "w0", "d0", 0

    def _weights(self, by: str, z: int) -> str:
        side = "d" if by == "term" else "w"
        mixed = " + ".join(f"w.p{i} * d.p{i}" for i in self.zs)
        return f"(SELECT c.{by}, sum(c.n / ({mixed}) * {side}.p{z}) AS t FROM c JOIN {self.w} w ON c.term = w.term JOIN {self.d} d ON c.url = d.url GROUP BY 1)"

    def _others(self, z: int, table: str = "x") -> str:
        return "".join(f", {table}.p{i}" for i in self.zs if i != z)

    def terms(self) -> Plsa:
        for z in self.zs:
            self.n += 1
            name = f"w{self.n}"
            self.cte += f", {name}a AS (SELECT x.term{self._others(z)}, x.p{z} * y.t AS p{z} FROM {self.w} x JOIN {self._weights('term', z)} y ON x.term = y.term)"
            self.cte += f", {name} AS (SELECT x.term{self._others(z)}, x.p{z} / s.s AS p{z} FROM {name}a x, (SELECT sum(p{z}) AS s FROM {name}a) s)"
            self.w = name
        return self

    def documents(self) -> Plsa:
        for z in self.zs:
            self.n += 1
            name = f"d{self.n}"
            self.cte += f", {name} AS (SELECT x.url{self._others(z)}, x.p{z} * y.t AS p{z} FROM {self.d} x JOIN {self._weights('url', z)} y ON x.url = y.url)"
            self.d = name
        total = " + ".join(f"p{z}" for z in self.zs)
        self.cte += f", done{self.n} AS (SELECT url, " + ", ".join(f"p{z} / ({total}) AS p{z}" for z in self.zs) + f" FROM {self.d})"
        self.d = f"done{self.n}"
        return self

    def rows(self, side: str) -> str:
        key, table = ("term", self.w) if side == "terms" else ("url", self.d)
        return " UNION ALL ".join(f"SELECT {key}, {z} AS topic, p{z} AS p FROM {table}" for z in self.zs)
