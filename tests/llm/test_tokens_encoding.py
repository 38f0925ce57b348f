import os
import random
import re
import sys

import pytest

from linkloom.llm import encode, encoding_repair, packing

sys.path.insert(0, os.path.dirname(__file__))
from languages import SENTENCES  # noqa: E402

VOCABULARY = f"{encode.FOLDER}/byte_bpe_50k.json"
needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")

ODD = [
    None, "", " ", "\n\n  x", "don't I'll we'd", "<|endoftext|>", "a" * 3000, "=" * 500, "äöü слово 中文字 \U0001f41d\U0001f469‍\U0001f33e", "\x00\x01\x7f  �", "1234567 12.5 Ⅷ ½",
    "tab\tnew\r\nline  two   three", "Ã©Ã¼", "ab" * 700, "The cat sat on the mat. " * 400, " 　x", "สวัส الس",
]


@needs
def test_ids_against_the_library(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    known.encode_special_tokens = True
    rng = random.Random(0)
    given = [*ODD, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x3000, 0x30FF), 32, 10])) for _ in range(rng.randrange(60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").selectExpr("*", "1 as key", "2 as ids", "3 as n_tokens")
    got = {r["doc_id"]: r["ids"] for r in encode.token_ids(df, "doc_id", "text").collect()}
    assert got == {k: known.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(given)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    back = {k: known.decode(v, skip_special_tokens=False) for k, v in got.items()}
    assert all(back[k] == (t or "") for k, t in enumerate(given))
    assert {r["doc_id"]: r["text"] for r in encode.texts_of(encode.token_ids(df, "doc_id", "text"), "doc_id").collect()} == {k: t or "" for k, t in enumerate(given)}


@needs
def test_ids_without_text(spark):
    df = spark.createDataFrame([(1, [15496, 11]), (1, []), (None, None), (3, [15496, 999_999]), (4, [None]), (5, [250, 50256])], "k long, ids array<int>").selectExpr("*", "1 as key", "2 as text")
    assert sorted((str(r["k"]), str(r["text"])) for r in encode.texts_of(df, "k").collect()) == sorted([("1", "Hello,"), ("1", ""), ("None", ""), ("3", "None"), ("4", "None"), ("5", "\ufffd<|endoftext|>")])
    assert encode.texts_of(df.limit(0), "k").count() == 0


@needs
def test_long_words_take_the_same_way():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(7)
    words = ["a" * n for n in (1, 2, 3, 7, 500, 5001)] + ["ab" * 900, "abc" * 700, "!" * 333, "".join(rng.choice("abcdefgh") for _ in range(4000)), "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(1500)), "ก" * 999]
    e = encode.Encoder(open(VOCABULARY, "rb").read())
    assert e.encode(words) == [known.encode(w, add_special_tokens=False).ids for w in words]


@needs
def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(encode, "KNOWN", 3)
    e = encode.Encoder(open(VOCABULARY, "rb").read())
    first = e.encode(["one two three four", "five", None])
    assert e.encode(["six seven", "one two three four"])[1] == first[0]
    assert e.encode([]) == []


@needs
def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, text string")
    assert encode.token_ids(df, "doc_id", "text").count() == 3
    assert encode.token_ids(df.limit(0), "doc_id", "text").count() == 0


def check(placed, items, containers):
    by = {}
    for r in placed:
        by.setdefault(r["container_id"], []).append(r)
    for c, size in containers.items():
        rows = by.get(c, [])
        room, given = {}, {}
        for r in rows:
            given.setdefault(r["key"], []).append((r["piece_no"], r["n_tokens"]))
            assert (r["pack_id"] is None) == (r["n_tokens"] == 0)
            if r["n_tokens"]:
                room[r["pack_id"]] = room.get(r["pack_id"], 0) + r["n_tokens"]
        assert max(room.values(), default=0) <= size
        assert sorted(room) == list(range(len(room)))
        assert {k: sorted(v) for k, v in given.items()} == {k: [(i, min(size, max(n or 0, 0) - i * size)) for i in range(max(1, -(-max(n or 0, 0) // size)))] for k, n in items}
    return {c: len({r["pack_id"] for r in by.get(c, []) if r["n_tokens"]}) for c in containers}


@pytest.mark.parametrize("buckets", [1, 16])
def test_filling(spark, buckets):
    rng = random.Random(5)
    items = [(k, rng.choice([0, None, 7, 7, 7, 64, 100, 129, -3, rng.randrange(1, 300)])) for k in range(900)]
    df = spark.createDataFrame(items, "key long, n long").selectExpr("key", "n", "1 as bucket", "2 as capacity", "3 as n_tokens")
    placed = packing.fill_containers(df, "key", "n", {1: 64, 2: 128}, buckets)
    packs = check(placed.collect(), items, {1: 64, 2: 128})
    report = {r["container_id"]: r for r in packing.fill_report(placed, {1: 64, 2: 128}).collect()}
    for c, n in packs.items():
        assert report[c]["packs"] == n
        assert n <= report[c]["least_packs"] * 1.1 + 1


def test_equal_keys_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "key long, n long")
    placed = packing.fill_containers(df, "key", "n", {1: 10}).collect()
    assert len(placed) == 3
    assert len({r["pack_id"] for r in placed}) == 2


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([], "key long, n long")
    assert packing.fill_containers(df, "key", "n", {1: 10}).count() == 0
    for bad in ({}, {1: 0}, dict.fromkeys(range(200), 5)):
        with pytest.raises(ValueError):
            packing.fill_containers(df, "key", "n", bad)
    with pytest.raises(ValueError):
        packing.pack({11: 1}, 10)


def one_by_one(lengths, capacity):
    """Each item, longest first, into the emptiest open pack that it fits."""
    packs = []
    for n in sorted(lengths, reverse=True):
        at = min(range(len(packs)), key=lambda k: packs[k], default=None)
        if at is not None and packs[at] + n <= capacity:
            packs[at] += n
        else:
            packs.append(n)
    return sorted(packs)


@pytest.mark.parametrize("seed", range(5))
def test_histogram_is_item_by_item(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) if rng.random() < 0.5 else rng.randrange(1, 30) for _ in range(rng.randrange(1, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    got = packing.pack(histogram, 100)
    room = sorted(sum(s * k for s, k in p) for n, p in got for _ in range(n))
    assert sum(room) == sum(lengths)
    assert len(room) <= len(one_by_one(lengths, 100)) + 1
    back = {}
    for n, p in got:
        for s, k in p:
            back[s] = back.get(s, 0) + n * k
    assert back == histogram


SAMPLES = {
    "fr": "La façade du château — déjà très âgée — coûtait 98 € à Noël…",
    "pl": "Może każdy ścigł źródło, które było już między nami, żeby zostać",
    "ru": "Если они только были между нами, это наше",
    "el": "Το σπίτι είναι κοντά στη θάλασσα και το βουνό",
    "ja": "風と紙の石は、海で木を見た。",
}


@pytest.mark.parametrize(
    ("lang", "read", "written"),
    [
        ("fr", "cp1252", "utf-8"), ("fr", "latin-1", "utf-8"), ("fr", "mac_roman", "utf-8"), ("fr", "cp437", "utf-8"), ("pl", "cp1252", "utf-8"), ("pl", "cp1250", "utf-8"), ("pl", "cp1252", "cp1250"), ("pl", "latin-1", "iso8859-2"),
        ("ru", "cp1252", "utf-8"), ("ru", "cp1251", "utf-8"), ("ru", "cp1252", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "cp1251", "cp866"), ("el", "cp1252", "utf-8"), ("el", "cp1252", "cp1253"), ("ja", "latin-1", "utf-8"), ("ja", "cp1252", "cp932"), ("ja", "latin-1", "euc_jp"),
    ],
)
def test_round_trip(lang, read, written):
    text = SAMPLES[lang] if (lang, written) != ("pl", "iso8859-2") else SAMPLES[lang]
    raw = text.encode(written)
    garbled = raw.decode("latin-1") if read == "latin-1" else "".join(bytes([b]).decode(read) if _has(read, b) else chr(b) for b in raw)
    bad, restored, layers, whole = encoding_repair.examine("Plain words. " + garbled + "\nMore plain words.")
    assert bad
    assert whole
    assert layers >= 1
    assert restored == "Plain words. " + text + "\nMore plain words."


def _has(codec, b):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


def test_nested_layers():
    text = SAMPLES["fr"]
    twice = text
    for _ in range(2):
        twice = twice.encode("utf-8").decode("latin-1")
    assert encoding_repair.examine(twice) == (True, text, 2, True)


def test_part_of_a_text():
    assert encoding_repair.examine("A cafÃ© near the cafés of old, and a long way from it a naïve one.")[:2] == (True, "A café near the cafés of old, and a long way from it a naïve one.")


@pytest.mark.parametrize("text", [
    *SAMPLES.values(), None, "", "plain", "Þórð–Ðúra ÁÆÖ: Warm", "Visitors who see ZoÃ« instead of Zoë should tell us.", "A saved file turned über into Ã¼ber; here is how we noticed.",
    "├── src\n│   └── main", "שלום مرحبا สวัส", "ﬁne ﬂat", "5 m² at 3 °C, ½ of 98 € ± 2 × 3 → ∑", "\U0001f1ee\U0001f1f8 \U0001f469‍\U0001f33e", "¡Hola! ¿Qué tal, señor?", "«МИГ» № 5", "dẫn đá ước mơ",
])
def test_meant_signs_are_no_case(text):
    assert encoding_repair.examine(text) == (False, text, 0, True)


@pytest.mark.parametrize(("text", "wanted"), [
    ("Może to być tak¿e źródło.", "Może to być także źródło."), ("To jest tak¿e dobre miejsce", "To jest także dobre miejsce"), ("Może £ódŸ i źródło", "Może Łódź i źródło"),
    ("Źródło już jest.\nTo mo¿e byæ", "Źródło już jest.\nTo może być"), ("Bagda jeœli siê m¹ry, byæ œwiw", "Bagda jeśli się mąry, być świw"), ("‰Æ 風と紙の石は、海 と木", "家 風と紙の石は、海 と木"),
])
def test_one_garbled_piece(text, wanted):
    assert encoding_repair.examine(text)[:2] == (text != wanted, wanted)


@pytest.mark.parametrize("text", [
    "Le mot† est déjà là, à côté.", "słowo¹ jest już źródłem", "A×B in naïve cafés", "µmol già così è", "casa¿dónde está el niño según él", "ord† på øya, så", "嘢 我哋 風紙", "Київ це місто, де ці люди", "m³ and 5°C n° 5", "5 µm is naïve",
])
def test_one_sign_is_no_case(text):
    assert encoding_repair.examine(text) == (False, text, 0, True)


def test_layers_without_bound():
    text = SAMPLES["fr"]
    garbled = text
    for _ in range(6):
        garbled = garbled.encode("utf-8").decode("latin-1")
    assert encoding_repair.examine(garbled) == (True, text, 6, True)


def test_cost_that_is_left_is_not_whole():
    assert encoding_repair.examine("cafÃ© ᚠab")[::3] == (True, False)


def test_lost_characters_name_the_text():
    assert encoding_repair.examine("Gr�n and blue") == (True, "Gr�n and blue", 0, False)


def test_repair_of_tables(spark):
    data = [(1, "cafÃ© Ã¼ber"), (1, "cafÃ© Ã¼ber"), (2, None), (3, ""), (None, "naÃ¯ve"), (4, "ok")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as key", "2 as garbled", "3 as restored")
    assert sorted(str(r["doc_id"]) for r in encoding_repair.garbled_keys(df, "doc_id", "text").collect()) == ["1", "1", "None"]
    got = encoding_repair.repaired(df, "doc_id", "text").collect()
    assert len(got) == 6
    assert {r["restored"] for r in got} == {None, "café über", "naïve"}
    assert encoding_repair.repaired(df.limit(0), "doc_id", "text").count() == 0
    long = "x " * 200_000 + "cafÃ©"
    assert encoding_repair.examine(long)[1].endswith("café")


@pytest.mark.parametrize("language", sorted(SENTENCES))
def test_right_text_in_any_language_is_no_case(language):
    text = SENTENCES[language]
    for piece in (text, *re.split("(?<=[.!?]) ", text), *text.split(" ")):
        assert encoding_repair.examine(piece) == (False, piece, 0, True)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251"])
def test_languages_come_back_from_utf8(read):
    wrong = []
    for language, text in SENTENCES.items():
        garbled = "".join(bytes([b]).decode(read) if _has(read, b) else chr(b) for b in text.encode())
        if garbled == text:
            continue
        bad, restored, _, _ = encoding_repair.examine(garbled)
        assert bad, language
        wrong += [language] if restored != text else []
    assert len(wrong) <= 2, wrong


@pytest.mark.parametrize("text", ["We met at the café, the cafÃ© was full and cheap.", "Ã¼ber über Ã¶l cafÃ© café"])
def test_a_right_form_near_is_no_quotation(text):
    assert encoding_repair.examine(text)[0]


def test_nothing_turns_at_no_drop():
    for text in ("Il dit : —à demain, l’été viendra—ou pas. mot—à mot", "Рівне Сім’я Рі СЄ", "┌──┬──┐ ÁÆÖ: Þórð"):
        assert encoding_repair.examine(text) == (False, text, 0, True)
