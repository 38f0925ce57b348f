"""The pN_ queries, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical
from linkloom.llm import encode, encoding_repair, main_content, near_copies, packing, site_lines, term_frequency
from linkloom.llm.arrow import spread, table


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its counts and its mark."""
    return term_frequency.marked_terms(table(spark, d, "term_counts"), "term", "url", "n")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("term", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.main_lines(table(spark, d, "pages"))


def page_features(spark: SparkSession, d: str, short: bool = False) -> DataFrame:
    """Runs of three words of the main bodies; with ``short`` those of one or two words are one run."""

    def run(x: dict[str, list]) -> list:
        return [near_copies.shingles("" if bad else " ".join(own[k - 1].text for k in numbers), 3, short) for own, numbers, _, bad in main_content.read_pages(x["html"])]

    rows = spread(table(spark, d, "pages").select(F.col("page_id").alias("key"), "html"))
    return near_copies.features(rows, run, "bigint")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = near_copies.near_copies(page_features(spark, d), 0.5)
    return near_copies.all_pairs(pairs, members).select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its class and its number of similar pages."""
    pairs, members = near_copies.near_copies(page_features(spark, d, short=True), 0.5)
    found = near_copies.with_single(near_copies.groups(pairs, members), table(spark, d, "pages"), "page_id")
    return found.select(F.col("key").alias("page_id"), F.col("group").alias("class_id"), "links")


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Near copies among documents.text: five words, 0.8."""
    documents = table(spark, d, "documents")
    pairs, members = near_copies.near_copies(near_copies.text_features(documents, "doc_id", "text", short=True), 0.8)
    return near_copies.with_single(near_copies.groups(pairs, members), documents, "doc_id").select(F.col("key").alias("doc_id"), F.col("group").alias("class_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the sequences that PrefixSpan finds."""
    return site_lines.frequent_lines(site_lines.line_sequences(table(spark, d, "pages")))


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of lines of any length that come back within a site."""
    return site_lines.frequent_sequences(site_lines.line_sequences(table(spark, d, "pages")))


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each page's text without the lines that come back."""
    return site_lines.without_repeats(table(spark, d, "pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.stuffed_pages(table(spark, d, "pages"), table(spark, d, "edges"), table(spark, d, "documents_v"))


def p5_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every page, with the number of its links in edges or, where that is more, the outdegree that the crawler stored."""
    pages = table(spark, d, "pages")
    urls = pages.select("page_id", canonical(F.col("url")).alias("u"))
    counts = main_content.link_counts(table(spark, d, "edges"), table(spark, d, "documents_v"))
    return main_content.stuffing_measures(pages).join(urls, "page_id").join(counts, "u", "left").drop("u")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all documents, from their ids."""
    return encode.texts_of(p6_ids(spark, d), "doc_id")


def capacities(spark: SparkSession, d: str) -> dict[int, int]:
    """The kinds of containers: three rows."""
    rows = table(spark, d, "containers").where("container_id is not null and capacity > 0").limit(packing.CONTAINERS + 1).collect()
    return {r["container_id"]: r["capacity"] for r in rows}


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    counts = encode.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.fill_containers(counts, "doc_id", "n_tokens", capacities(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packs(spark, d), capacities(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.garbled_keys(table(spark, d, "documents"), "doc_id", "text")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled texts with what they said, as far as it can be known."""
    return encoding_repair.repaired(table(spark, d, "documents"), "doc_id", "text").where("garbled").drop("garbled")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_terms, p2_found, p3_found, p3_groups, p3_documents, p4_found, p4_sequences, p4_texts, p5_found, p5_measures, p6_ids, p6_texts, p7_packs, p7_report, p8_found, p8_restored)}


def lines_sql(page: str) -> str:
    """The text lines of a page as a list, in lower case and with digits made alike: white space first, then what ends a line, then the rest of the markup, then references."""
    x = f"regexp_replace({page}, '\\s', ' ', 'g')"
    for pattern, to in (
        ("<!--.*?-->", "''"), ("<!--.*$", "''"), ("(?i)<!doctype[^>]*(>|$)", "''"), ("(?i)<(script)\\b[^>]*>.*?(</script *>|$)", "chr(10)"), ("(?i)<(style)\\b[^>]*>.*?(</style *>|$)", "chr(10)"),
        ("(?i)</?(a|abbr|b|cite|code|em|i|mark|small|span|strong|sub|sup|time|u)( [^>]*|/)?(>|$)", "''"), ("(?i)</?[a-z][a-z0-9]*( [^>]*|/)?(>|$)", "chr(10)"), ("<[?!][^>]*>", "''"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    names = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in name2codepoint.items()) + "}"
    ref = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
    code = f"(CASE WHEN {ref} = '' THEN NULL WHEN {ref} LIKE '#x%' OR {ref} LIKE '#X%' THEN ('0x' || substr({ref}, 3))::INTEGER WHEN {ref} LIKE '#%' THEN substr({ref}, 2)::INTEGER ELSE element_at({names}, {ref})[1] END)"
    told = f"array_to_string(list_transform(string_split(t, '&'), lambda p, i: CASE WHEN i > 1 THEN CASE WHEN {code} IS NOT NULL THEN chr({code}) || substr(p, length({ref}) + 2) ELSE '&' || p END ELSE p END), '')"
    blank = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
    line = f"regexp_replace(lower(replace(trim(regexp_replace({told}, '{blank}', ' ', 'g')), 'İ', 'i̇')), '[0-9]+', '0', 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda t: {line}), lambda t: t <> '')"


def oracle_sql() -> dict[str, str]:
    # Fixed value: the characters of category Cf.
    cf = "\\x{AD}\\x{600}-\\x{605}\\x{61C}\\x{6DD}\\x{70F}\\x{890}\\x{891}\\x{8E2}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FEFF}\\x{FFF9}-\\x{FFFB}"
    cut = "regexp_replace(url, '[#?](.|\n)*$', '')"
    url = f"""CASE WHEN regexp_matches({cut}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
        regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({cut}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1'), '$', '')
        || coalesce(nullif(regexp_replace({cut}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), ''), '/') ELSE {cut} END"""
    terms = f"""
        WITH t AS (SELECT regexp_replace(regexp_replace(lower(nfc_normalize(regexp_replace(term, '[{cf}]', '', 'g'))), '^[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ''), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+$', '') AS term, n, {url} AS u FROM term_counts WHERE url IS NOT NULL),
        a AS (SELECT count(DISTINCT u) AS every FROM t),
        c AS (SELECT term, sum(coalesce(n, 0))::BIGINT AS occurrences, count(DISTINCT u) AS records FROM t WHERE term <> '' GROUP BY term)
        SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * every THEN 'common' END AS mark FROM c, a"""
    cut_host = f"lower(regexp_extract({cut}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1))"
    host = f"nullif(regexp_replace(regexp_replace({cut_host}, '^.*@', ''), ':[0-9]*$', ''), '')"
    lines = f"SELECT host, line FROM (SELECT {host} AS host, {url} AS u, unnest({lines_sql('html')}) AS line FROM pages WHERE url IS NOT NULL AND html <> '') WHERE host IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT u) >= 5"
    return {"p4_found": lines, "p1_terms": terms, "p1_found": f"SELECT term, mark FROM ({terms}) WHERE mark IS NOT NULL", "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
