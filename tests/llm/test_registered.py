"""Every registered query over whole tables at the smallest scale; those with SQL are held against it, the others against each other."""

import glob
import os

import duckdb
import pytest

from linkloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
FOUND: dict[str, list[dict]] = {}


def rows(spark, name):
    if name not in FOUND:
        FOUND[name] = [r.asDict() for r in queries.queries()[name](spark, DATA).collect()]
    return FOUND[name]


def table(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    got = rows(spark, name)
    assert got
    if name not in queries.oracle_sql():
        return
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got[0]) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in got) == sorted(tuple(map(str, r)) for r in cursor.fetchall())


def test_they_agree(spark):
    pages, documents = table(spark, "pages"), table(spark, "documents")
    stuffed = {r["page_id"] for r in rows(spark, "p5_found")}
    assert stuffed >= {r["page_id"] for r in rows(spark, "p5_measures") if r["stuffed"]}
    assert not stuffed & {r["page_id"] for r in rows(spark, "p2_found")}
    assert {r["page_id"] for r in rows(spark, "p3_groups")} == {p["page_id"] for p in pages}
    group = {r["page_id"]: r["class_id"] for r in rows(spark, "p3_groups")}
    assert all(group[r["page_id_a"]] == group[r["page_id_b"]] and r["page_id_a"] < r["page_id_b"] for r in rows(spark, "p3_found"))
    assert {r["doc_id"] for r in rows(spark, "p3_documents")} == {d["doc_id"] for d in documents}
    lines = {(r["host"], r["line"]) for r in rows(spark, "p4_found")}
    assert lines == {(r["host"], x) for r in rows(spark, "p4_sequences") for x in r["lines"]}
    assert {r["doc_id"] for r in rows(spark, "p8_restored")} == {r["doc_id"] for r in rows(spark, "p8_found")}
    ids = {r["doc_id"]: len(r["ids"]) for r in rows(spark, "p6_ids")}
    assert set(ids) == {d["doc_id"] for d in documents}
    for kind in {r["container_id"] for r in rows(spark, "p7_packs")}:
        own = [r for r in rows(spark, "p7_packs") if r["container_id"] == kind]
        assert sum(r["n_tokens"] for r in own) == sum(ids.values())
        report = next(r for r in rows(spark, "p7_report") if r["container_id"] == kind)
        assert report["packs"] == len({r["pack_id"] for r in own if r["n_tokens"]})
