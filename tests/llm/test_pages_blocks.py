import os
import re
import sys

import numpy as np
import pytest

from linkloom.llm import blocks, main_content, train_blocks
from linkloom.llm.pages import Line, host, line_key, same_url, text_lines
from linkloom.llm.stuffing import autocorrelation, gaps, is_stuffed, profile, verdict

sys.path.insert(0, os.path.dirname(__file__))
from languages import SENTENCES  # noqa: E402


def lines(html):
    return [x.text for x in text_lines(html)]


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<title>T</title><p>a<b>b</b> c<br>d</p>", ["T", "ab c", "d"]), ("x<!-- <p> -->y", ["xy"]), ("a<script>if(1<2)'</p>'</script>b<style>c</style>", ["a", "b"]),
        ("<p>a&nbsp;  b\n\tc&amp;lt;</p>", ["a b c&lt;"]), ("<ul><li>1<li>2</ul>", ["1", "2"]), ("<p>one<p>two <a href='x'>three</a>", ["one", "two three"]),
        ("<p>cut <di", ["cut"]), ("<p>cut<!-- open", ["cut"]), ("<p>cut<script>var", ["cut"]), ("1 < 2<p>&copy", ["1 < 2", "©"]), ("", []), (None, []), ("<td>a</td><td> </td>", ["a"]),
    ],
)
def test_lines(html, wanted):
    assert lines(html) == wanted


def test_paths_and_links():
    got = text_lines('<div id="menu"><ul><li><a href="/">Home</a><li>News</ul></div><div class="c"><p>x<p>y</div>')
    assert [x.path for x in got] == [("div.menu", "ul", "li"), ("div.menu", "ul", "li"), ("div.c", "p"), ("div.c", "p")]
    assert [x.linked for x in got] == [1, 0, 0, 0]


def test_keys():
    assert line_key("Seen 12 Times 3") == "seen 0 times 0"
    assert same_url("HTTP://A:80#x") == "http://a/"
    assert host("https://u@WWW.A.example:8/x") == "www.a.example"
    assert host("x") is None


def test_same_url_is_the_column_rule(spark):
    from pyspark.sql import functions as F

    from linkloom.functions import urls

    given = ["HTTP://A:80/x?y", "https://b:443", "http://b:443/", "mailto:x", "", "http://c/#", "HTTPS://U@C/Q", "//x/y", "http://d"]
    got = spark.createDataFrame([(g,) for g in given], "u string").select("u", urls.canonical(F.col("u")).alias("c"), urls.host_of(F.col("u")).alias("h")).collect()
    for r in got:
        assert (r["c"], r["h"]) == (same_url(r["u"]), host(r["u"])), r


def page(main, title="Mild trail", site="Some Site"):
    return f"""<html><head><title>{title} - {site}</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>
<main><h1>{title}</h1><p class="by">By Ann Bell</p>{main}</main>
<aside><h4>Topics</h4><ul><li><a href="/t">tin</a></li></ul></aside><footer><p>&copy; 2020 {site}. All rights reserved. No part of this site may be copied without written consent of the publisher.</p><p>Terms of use | Privacy | Imprint | Accessibility</p></footer></body></html>"""


MORE = "".join(f"<p>When Ann Bell first saw the {a} tile, the {b} was already blunt and the {c} was gone. It is the modest guide which anchors the {c}, not the {b} or the second wire.</p>" for a, b, c in (("smooth", "bivouac", "pin"), ("grey", "kettle", "arm"), ("dry", "circle", "stem")))
BODY = MORE + "<p>The waymark and the pocket were sharp until the notch near the bridge gave way. Every boot has a ribbon that warmly breaks the ridge.</p><p>After 126 days the boots were as level as the hook, and the wall was not.</p>"


def found(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    own = text_lines(html)
    return [own[r["line_no"] - 1].text for r in main_content.main_lines(df).orderBy("line_no").collect()]


def test_main_body(spark):
    got = found(spark, page(BODY + "<p>Read also: Other thing</p>" + MORE))
    assert got[0] == "Mild trail"
    assert len(got) == 9
    assert not any("Read also" in x or "rights" in x or "By Ann" in x for x in got)


def test_no_main_body(spark):
    assert found(spark, page("").replace("<p class=\"by\">By Ann Bell</p>", "<p>The page you asked for has moved or never existed. Try the search or return to the front page.</p>").replace("Mild trail", "Page not found")) == []
    assert found(spark, None) == []
    assert found(spark, page("<ul>" + "".join(f'<li><a href="/{k}">Blunt dew {k % 7}</a></li>' for k in range(60)) + "</ul>")) == []


def test_long_pages_and_odd_input(spark):
    html = page(BODY * 1500)
    df = spark.createDataFrame([(None, html, "k"), (2, "", "l"), (2, html, "l"), (3, "<", "x")], "page_id long, html string, key string").withColumnRenamed("key", "lines")
    got = main_content.main_lines(df)
    assert got.where("page_id is null").count() == got.where("page_id = 2").count() > 2900
    assert main_content.main_lines(df.limit(0)).count() == 0
    assert main_content.stuffing_measures(df.limit(0)).count() == 0
    assert {(r["page_id"], r["stuffed"]) for r in main_content.stuffing_measures(df).collect()} == {(None, False), (2, False), (3, False)}
    assert {(r["page_id"], r["body"] == "") for r in main_content.main_text(df).collect()} == {(None, False), (2, False), (2, True), (3, r_empty(df))}


def r_empty(df):
    return main_content.main_text(df).where("page_id = 3").first()["body"] == ""


def test_gradients_are_those_of_the_loss():
    w = {k: v.astype(np.float64) for k, v in train_blocks.start(1).items()}
    pages = [text_lines(page(BODY)), text_lines(page("<p>x</p>"))]
    labels = [np.arange(len(p)) % 2.0 for p in pages]
    w = {k: v.astype(np.float32) for k, v in w.items()}
    _, g = train_blocks.gradients(w, pages, labels)
    rng = np.random.default_rng(0)
    for name in w:
        flat = g[name].ravel()
        for at in rng.choice(np.nonzero(np.abs(flat) > np.abs(flat).max() * 0.3)[0], 2):
            loss = []
            for d in (1e-2, -1e-2):
                v = {k: x.copy() for k, x in w.items()}
                v[name].ravel()[at] += d
                loss.append(train_blocks.gradients(v, pages, labels)[0])
            assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(flat[at], rel=0.05, abs=2e-4), name


def test_training_learns_and_holds_on_held_out_hosts():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(200)]
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    pages = []
    for k in range(120):
        body = "".join(f"<p>{text(12)}</p>" for _ in range(5))
        pages.append((f"http://h{k % 24}.example/{k}", text_lines(page(body, title=f"Title {text(2)}", site=f"Site {k % 24}"))))
    said = []
    train_blocks.train(pages, epochs=6, batch=8, say=said.append)
    right = [float(s.split(": ")[1].split()[0]) for s in said if s.startswith("held-out")]
    assert min(right) > 0.9


def test_shipped_weights_on_pages_that_tell():
    """Held against the markup's own word, on whole pages of other shape than those trained on."""
    one = text_lines(page(BODY))
    p = blocks.labeller().chances([one, [], one])
    assert len(p[1]) == 0
    assert np.allclose(p[0], p[2], atol=1e-5)
    wanted = [x.path and any(t.startswith("main") for t in x.path) and "By Ann" not in x.text for x in one]
    assert ((p[0] > 0.5) == np.array(wanted)).mean() > 0.95


def own(*texts, linked=0.0):
    from linkloom.llm.pages import Line

    return [Line("Heading", ("h1",), 0.0, ()), *(Line(t, ("p",), linked, ()) for t in texts)]


def test_stuffing():
    assert is_stuffed(profile(own("tin bowl near me, cheap tin bowl, buy bowl tin, best tin, tin bowl discount, top bowl " * 9)))
    assert is_stuffed(profile(own(*(f"derailleur Place{k}" for k in range(40)))))
    assert is_stuffed(profile(own(*(f"Level dome {k}" for k in range(30)), linked=1.0)))
    assert is_stuffed(profile(own("bank-12 #gate pocket STONE sail #tin-4 clear winter oven, drone simple #mast-77 " * 5)))
    assert not is_stuffed(profile(own(*("The bank was as loose as the angle, and the sail was not. It is the pale hook which draws it.",) * 8)))
    # entries with sentences of their own
    assert not is_stuffed(profile(own(*(x for k in range(9) for x in (f"Level dome {k}", "It is the place where the dome of the village was built before the river moved away.")))))
    assert not is_stuffed(profile(own()))
    assert not is_stuffed(profile([]))


def test_stuffing_in_sentences():
    line = "Cheap flights to Rome, hotels in Rome for the family, best of Rome."
    alike = [f"Cheap {a} to {c}, {b} in {c} for the family, best of {c}." for c in ("Rome", "Paris") for a in ("flights", "trips", "tours") for b in ("hotels", "rooms", "beds")]
    for lines in ([line] * 20, alike):
        measured = profile(own(*lines), every=False)
        assert measured["bare_share"] == 0
        assert is_stuffed(measured)
    # few words
    assert is_stuffed(profile(own("tin bowl, buy tin bowl, cheap tin bowl")))
    assert not is_stuffed(profile(own("Closed until further notice")))
    assert not is_stuffed(profile(own("The cat saw the cat.")))


def test_half_and_half():
    sentence = "It is the place where the dome of the village was built before the river moved away."
    few = own(sentence, sentence, "tin bowl cheap tin bowl best tin bowl")
    assert not is_stuffed(profile(few))
    many = own(sentence, "tin bowl cheap tin bowl best tin bowl " * 8)
    assert is_stuffed(profile(many))
    assert is_stuffed(profile(many, every=False))


def test_sequence_measures():
    regular = np.tile(np.arange(5), 20)
    assert autocorrelation(regular) > 0.7
    assert gaps(regular) == (0.95, 1.0)
    assert autocorrelation(np.arange(100)) == pytest.approx(-0.01)
    assert gaps(np.arange(100)) == (0.0, 0.0)


@pytest.mark.parametrize("language", sorted(set(SENTENCES) - {"Phonetic", "Mathematics"}))
def test_prose_in_any_language_is_not_stuffed(language):
    text = SENTENCES[language]
    pieces = [x for x in re.split("(?<=[.!?。])", text) if x.strip()]
    for texts in ([text], [text] * 3, pieces, [text, *pieces]):
        assert verdict(profile(own(*texts))) in (False, None)
        assert not is_stuffed(profile(own(*texts)))


@pytest.mark.parametrize("language", sorted(set(SENTENCES) - {"Phonetic", "Mathematics", "Thai", "Japanese", "Chinese", "Traditional Chinese"}))
def test_keywords_in_any_language_are_stuffing(language):
    words = [w.strip(".,;:!?¿¡—·») ") for w in SENTENCES[language].split() if len(w) > 3][:5]
    rng = np.random.default_rng(1)
    rows = [" ".join(rng.choice(words, 12)).capitalize() for _ in range(12)]
    assert is_stuffed(profile(own(*rows)))
    assert is_stuffed(profile(own(*(r + "." for r in rows))))
    assert is_stuffed(profile(own(*(", ".join(r.split()) for r in rows))))


def test_links_decide_where_words_tell_nothing(spark):
    head = "<title>A long walk - Some Site</title><main><h1>A long walk</h1>"
    body = "".join(f"<p>{x}</p>" for x in ("we went over the hill and down to the old mill near the water", "nobody had seen the miller since the end of that cold winter", "so she opened the door herself and called his name twice"))
    data = [(1, "http://a.example/1", head + body), (2, "http://A.example/2#x", head + body), (3, None, head + body), (4, "http://a.example/4", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as u", "3 as least")
    links = spark.createDataFrame([("http://a.example/2", f"http://a.example/{k}") for k in range(80)] + [(None, "x"), ("http://a.example/1", "y")], "src string, dst string")
    stored = spark.createDataFrame([("http://a.example/1", 3), (None, 90), ("http://a.example/4", 900)], "url string, outdegree long")
    measured = {r["page_id"]: r for r in main_content.stuffing_measures(pages).collect()}
    assert measured[1]["bare_share"] == 1
    assert [r["page_id"] for r in main_content.stuffed_pages(pages, links, stored).collect()] == [2]
    assert main_content.stuffed_pages(pages).count() == 0
    assert main_content.stuffed_pages(pages.limit(0), links, stored).count() == 0


def test_long_pages_beside_short_ones_take_no_more_memory():
    big = [Line(f"Line {k} of the page.", ("p",), 0.0, ()) for k in range(5000)]
    small = [big[:12]] * 40
    labeller = blocks.labeller()
    whole, few = labeller.chances([big, *small]), labeller.chances([big, *small], volume=700)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(whole, few, strict=True))


def test_short_articles_in_any_language():
    """Plain articles of one to twelve paragraphs, of other shape than the pages trained on, in languages mostly not trained on."""
    wrong = lines = 0
    for language, text in SENTENCES.items():
        pieces = [x for x in re.split(r"(?<=[.!?。।]) ?", text) if x.strip()]
        for tag in ("main", "article", "div"):
            for many in (2, 3, 6, 13):
                body = "".join(f"<p>{x}</p>" for x in (pieces * 13)[:many])
                html = page("", title=" ".join(text.split()[:3])).replace('<main>', f"<{tag}>").replace('</main>', f"{body}</{tag}>").replace('<p class="by">By Ann Bell</p>', "")
                read = text_lines(html)
                head = next(k for k, x in enumerate(read) if x.path[-1] == "h1")
                wanted = np.array([head <= k <= head + many for k in range(len(read))])
                got = blocks.labeller().chances([read])[0] > 0.5
                wrong += int((got != wanted).sum())
                lines += len(read)
    assert wrong <= 0.04 * lines, (wrong, lines)
