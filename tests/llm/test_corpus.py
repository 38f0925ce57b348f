import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from linkloom.llm import near_copies, site_lines, term_frequency
from linkloom.llm.pages import host, line_key, same_url, text_lines


def test_term_frequency_against_sets(spark):
    rng = random.Random(2)
    spell = ["café", "café", " CAFÉ ", "ca­fé", "tin", "Tin​", "­", " ", None, "İx", "b"]
    urls = [None, "http://A/1#x", "http://a/1", "http://a:80/1?q", *(f"http://a/{k}" for k in range(2, 9))]
    data = [(rng.choice(spell), rng.choice(urls), rng.choice([None, 1, 2, 5]), "x") for _ in range(400)]
    data += [("hot", f"http://h/{k % 50}", 1, "x") for k in range(400)]
    occ, recs, every = Counter(), defaultdict(set), set()
    for t, u, n, _ in data:
        if u is None:
            continue
        every.add(same_url(u))
        key = unicodedata.normalize("NFC", "".join(c for c in t or "" if unicodedata.category(c) != "Cf")).lower().strip()
        if key:
            occ[key] += n or 0
            recs[key].add(same_url(u))
    df = spark.createDataFrame(data, "term string, url string, n long, occurrences string")
    assert {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency.term_frequency(df, "term", "url", "n").collect()} == {k: (occ[k], len(v)) for k, v in recs.items()}
    mark = {k: "rare" if len(v) < 3 else "common" if len(v) > 0.3 * len(every) else None for k, v in recs.items()}
    assert {r["term"]: r["mark"] for r in term_frequency.marked_terms(df, "term", "url", "n").collect()} == mark
    assert term_frequency.marked_terms(df.limit(0), "term", "url", "n").count() == 0
    assert term_frequency.term_frequency(df.where("term is null"), "term", "url").count() == 0


def test_share_is_of_all_records(spark):
    # the term is on 1 of 2 addresses with terms, but on 3 of 20 of all
    data = [("t", f"http://a/{k}") for k in range(3)] + [(None, f"http://a/{k}") for k in range(3, 20)]
    assert term_frequency.marked_terms(spark.createDataFrame(data, "term string, url string"), "term", "url").first()["mark"] is None


def texts(rng, n):
    words = [f"w{k}" for k in range(300)]
    base = [rng.choices(words, k=rng.randint(20, 60)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("width", "similarity"), [(3, 0.5), (5, 0.8)])
def test_near_copies_against_all_pairs(spark, width, similarity):
    rng = random.Random(width)
    t = texts(rng, 160)
    data = list(enumerate(t + t[:30] + ["", None, "too few"])) + [(None, t[0])]
    sets = {k: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for k, x in data if k is not None for w in [(x or "").split()]}
    wanted = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    df = spark.createDataFrame(data, "id long, text string").selectExpr("id", "text", "1 as key", "2 as n", "3 as own")
    pairs, members = near_copies.near_copies(near_copies.text_features(df, "id", "text", width), similarity)
    assert {(r["a"], r["b"]) for r in near_copies.all_pairs(pairs, members).collect()} == wanted
    group = {r["key"]: (r["group"], r["links"]) for r in near_copies.groups(pairs, members).collect()}
    every = {r["key"]: (r["group"], r["links"]) for r in near_copies.with_single(near_copies.groups(pairs, members), df, "id").collect()}
    assert every == {k: (k, 0) for k in sets} | group
    label = {k: k for k in sets if sets[k]}
    for _ in range(len(label)):
        new = {k: min([label[k], *(label[b if a == k else a] for a, b in wanted if k in (a, b))]) for k in label}
        if new == label:
            break
        label = new
    assert {k: g for k, (g, _) in group.items()} == label
    assert {k: n for k, (_, n) in group.items()} == {k: sum(k in p for p in wanted) for k in label}


@pytest.mark.parametrize("hot", [1, 3, 20])
@pytest.mark.parametrize(("width", "similarity"), [(3, 0.5), (5, 0.8), (3, 0.2)])
def test_skipped_lists_lose_no_pair(spark, width, similarity, hot):
    rng = random.Random(width)
    data = list(enumerate(texts(rng, 80)))
    df = spark.createDataFrame(data, "id long, text string")
    feats = near_copies.text_features(df, "id", "text", width)
    plain, _ = near_copies.near_copies(feats, similarity)
    skipped, _ = near_copies.near_copies(feats, similarity, hot)
    assert plain.count() > 0
    assert sorted(tuple(r) for r in skipped.collect()) == sorted(tuple(r) for r in plain.collect())


def test_one_coordinate_of_very_many_texts_pairs_nobody(spark):
    import numpy as np
    from pyspark.sql import functions as F

    many = 100_000

    def go(batches):
        import pyarrow as pa

        for b in batches:
            key = b.column(0).to_numpy()
            at = np.random.default_rng(int(key[0]) + 1).integers(0, 1 << 63, (len(key), near_copies.COORDINATES), dtype=np.uint64)
            at[:, 0] = 7  # one for all
            twins = key >= many - 2
            at[twins, 1:6] = [11, 12, 13, 14, 15]
            yield pa.RecordBatch.from_pydict({"key": key, "n": np.full(len(key), 100, np.int32), "at": [x.tobytes() for x in at]})

    reps = spark.range(many).mapInArrow(go, "key long, n int, at binary")
    found = near_copies.candidates(reps, 0.5).agg(F.count("*"), F.min("a"), F.max("b")).first()
    assert tuple(found) == (1, many - 2, many - 1)


def test_minima_in_pieces(monkeypatch):
    own = near_copies.shingles(" ".join(f"w{k}" for k in range(500)), 3)
    whole = near_copies.minima(own)
    monkeypatch.setattr(near_copies, "CHUNK", 7)
    assert (near_copies.minima(own) == whole).all()


def test_many_exact_copies_are_one_class(spark):
    df = spark.createDataFrame([(k, "one two three four five six seven") for k in range(3000)] + [(9999, "one two three four five six eight")], "id long, text string")
    pairs, members = near_copies.near_copies(near_copies.text_features(df, "id", "text", 3), 0.5)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(0, 9999)]
    assert {(r["group"], r["links"]) for r in near_copies.groups(pairs, members).collect()} == {(0, 3000)}


def test_short_texts_meet(spark, tmp_path):
    from linkloom.llm import queries

    data = [(1, "Two words"), (2, "two  WORDS!"), (3, "other words"), (4, "one two three four"), (5, "one two three four"), (6, "one two three four five"), (7, ""), (8, None), (9, "")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in queries.p3_documents(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0), 8: (8, 0), 9: (9, 0)}


def test_no_texts(spark):
    df = spark.createDataFrame([], "id long, text string")
    pairs, members = near_copies.near_copies(near_copies.text_features(df, "id", "text"), 0.8)
    assert (near_copies.all_pairs(pairs, members).count(), near_copies.groups(pairs, members).count()) == (0, 0)


def test_fewest_keeps_the_chance():
    for s in (0.5, 0.8):
        t = near_copies.fewest(near_copies.COORDINATES, s * s)
        rng = random.Random(1)
        miss = sum(sum(rng.random() < s * s for _ in range(near_copies.COORDINATES)) < t for _ in range(20000))
        assert miss <= 12


def html(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def site_data():
    rng = random.Random(4)
    data = []
    for k in range(40):
        h = rng.choice(["http://a.example", "http://A.example:80", "http://b.example"])
        body = [rng.choice(["Menu", "Terms", "Seen 12 times", "x"]) for _ in range(5)] + [f"own {rng.choice('abcdefgh')}", "Home", "About us", f"Shared {k} times"]
        data.append((k, f"{h}/{k % 25}" + rng.choice(["", "#t", "?q"]), html(body)))
    return [*data, (100, None, html(["Menu"])), (101, "http://b.example/1", None), (102, "http://b.example/2", ""), (103, "nothing", html(["Menu"]))]


def frequent(data, gap, least=5):
    """Plain search: supports of all patterns over the frequent lines of each page, then the closed ones."""
    pages = [(host(u), same_url(u), [line_key(x.text) for x in text_lines(h)]) for _, u, h in data if u and h and host(u)]
    alone = defaultdict(set)
    for h, u, seq in pages:
        for x in seq:
            alone[h, x].add(u)
    support = defaultdict(set)
    for h, u, seq in pages:
        seq = [x for x in seq if len(alone[h, x]) >= least]
        level = [((x,), i) for i, x in enumerate(seq)]
        while level:
            for p, _ in level:
                support[h, p].add(u)
            level = list({((*p, seq[j]), j) for p, i in level for j in range(i + 1, min(len(seq), i + gap + 2))})
    often = {k: len(v) for k, v in support.items() if len(v) >= least}
    inner = {(h, q, n) for (h, p), n in often.items() for q in (p[1:], p[:-1])}
    return {k: n for k, n in often.items() if (*k, n) not in inner}


@pytest.mark.parametrize(("gap", "local"), [(0, 10**6), (0, 20), (0, 0), (1, 10**6), (1, 60)])
def test_frequent_sequences_against_search(spark, gap, local):
    data = site_data()
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as line", "2 as host", "3 as key")
    got = site_lines.frequent_sequences(site_lines.line_sequences(df), gap=gap, local=local)
    wanted = frequent(data, gap)
    assert any(len(p) > 2 for _, p in wanted)
    assert sorted((r["host"], tuple(r["lines"]), r["support"]) for r in got.collect()) == sorted((*k, n) for k, n in wanted.items())


@pytest.mark.parametrize("local", [10**6, 30])
def test_sequences_of_any_length(spark, tmp_path, local):
    footer = [f"footer {c}" for c in "abcdefg"]
    data = site_data() + [(200 + k, f"http://c.example/{k}", html([f"own {c}" for c in "xyz"[: k % 3]] + footer[:3] + [f"only {'abcdefgh'[k]}"] + footer[3:])) for k in range(6)]
    data += [(200, "http://c.example/0", html(["other", *footer[:2]])), data[-1]]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    wanted = frequent(data, 0)
    assert ("c.example", tuple(line_key(x) for x in footer)) in wanted  # other lines lie between
    got = site_lines.frequent_sequences(site_lines.line_sequences(df), local=local)
    assert sorted((r["host"], tuple(r["lines"]), r["support"]) for r in got.collect()) == sorted((*k, n) for k, n in wanted.items())
    lines = {(r["host"], r["line"]) for r in site_lines.frequent_lines(site_lines.line_sequences(df), local=local).collect()}
    assert lines == {(h, x) for h, p in wanted for x in p}


def test_long_sequences_of_large_sites_ask_little_of_the_driver(spark):
    def asked(length):
        rows = [("c.example", list(range(length)), 6, None, None)]
        weighted = site_lines.written(spark.createDataFrame(rows, "host string, items array<long>, n long, r1 long, r2 long"))
        spark.sparkContext.setJobGroup(f"length {length}", "")
        try:
            found = site_lines.frequent_items(weighted, local=0)
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"length {length}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [(r["items"], r["support"]) for r in found.collect()] == [(list(range(length)), 6)]
        return jobs, len(found._jdf.queryExecution().analyzed().toString())

    few, many = asked(3), asked(11)
    assert many[0] - few[0] <= 8 * 5  # jobs a level
    assert many[1] < 1.1 * few[1]  # the plan of the result doesn't grow with the levels


def test_without_repeats(spark):
    data = site_data()
    often = {(h, x) for h, p in frequent(data, 0) for x in p}
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_lines.without_repeats(df).collect()}
    wanted = {k: "\n".join(x.text for x in text_lines(h) if (host(u), line_key(x.text)) not in often) for k, u, h in data if u and h and host(u)}
    assert got == wanted
    assert site_lines.without_repeats(df.limit(0)).count() == 0
    assert site_lines.frequent_sequences(site_lines.line_sequences(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        site_lines.frequent_sequences(site_lines.line_sequences(df), gap=-1)
