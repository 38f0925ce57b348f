"""Text that was decoded with the wrong character encoding: finding it, and round-trip repair.

A text is parted at blanks into tokens, and each distinct token that is not plain ASCII has a garbling cost: characters that make up
sequences of UTF-8, signs inside words, control characters, two scripts in a word, capitals amid small letters, Latin letters that no
alphabet holds together, lost characters. What is all of one script, in usual capitals and with usual signs, costs nothing, in any
language; letters that no one-byte encoding has can't come from one and cost nothing either. For a garbled text, candidates (the
encoding it was read in, the encoding it was written in) re-encode each token and strictly decode it; a token takes the result only
where its cost drops. The candidate that takes most cost off the whole text is kept (of equal ones that whose outcome has more of the
commonest letters), and the search repeats on the outcome for further layers, until no cost drops. A candidate that takes off little
turns only tokens that tell for themselves: the outcome is a usual word in the alphabet of its line or text, and what was turned is
more than a sign that writers set at words (footnote marks, times, micro). Of a text that is found garbled, tokens on the lines of garbled ones
follow by the same candidate where that costs nothing. What is left of lost characters can't be restored, but still names the text.

A garbled word is quoted, not garbled, where its right form stands in the same sentence and a word tells of the change.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_rows, spread

LATIN = "abcdefghijklmnopqrstuvwxyz"
# Letters beyond a-z of the alphabets of languages.
ALPHABETS = {
    "western": "àâäáãçéèêëíîïñóôöõúùûüßœæÿ",
    "italian": "àèéìíîòóùú",
    "polish": "ąćęłńóśźż",
    "czech": "áčďéěíňóřšťúůýžľĺŕäô",
    "turkish": "çğıiöşüâîû",
    "nordic": "áðéíóúýþæöåø",
    "hungarian": "áéíóöőúüű",
    "romanian": "ăâîșțşţ",
    "baltic": "āčēģīķļņšūžąęėįųõäöüō",
    "vietnamese": "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ",
    "south slavic": "čćđšž",
    "sorbian": "čćěłńóřśšžŕź",
    "turkmen": "çäžňöşüý",
    "azerbaijani": "çəğıöşü",
    "crimean": "âçğıñöşü",
    "welsh": "âêîôûŵŷáéíóúàèìòùäëïöüẁẃẅỳý",
    "maltese": "ċġħżàèìòù",
    "esperanto": "ĉĝĥĵŝŭ",
    "sami": "áčđŋšŧžâǩǧõäöå",
    "faroese": "áðíóúýæø",
    "greenlandic": "áâãêéîíôúûæøåĸ",
    "tahitian": "āēīōūàèìòùâêîôûé",
    "guarani": "ãẽĩñõũỹáéíóúýü",
}
NORDIC = frozenset(ALPHABETS["nordic"])
RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
SLAVIC = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґўђјљњћџѓќѕ")
GREEK = frozenset("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ")
SETS = [frozenset(LATIN + "ªºﬀﬁﬂﬃﬄ" + x) for x in ALPHABETS.values()]
# The commonest letters of Cyrillic, Greek and Latin texts.
COMMON = frozenset("оеаинтсрвлαοιετςνηρπeaionrtsl")
# Signs that stand within words.
JOINERS = frozenset("’‘'ʼ·-–—‐‑/_&@.,:;…+*=#~|\\!?()[]{}<>\"“”„«»‹›%$^`‚•→←")
TOKEN = re.compile(r"[^ \t\r\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


# A word of one alphabet in usual capitals, with usual signs around it
PLAIN = re.compile(
    r"[\[(“„\"'«¿¡]*(?:"
    + "|".join(f"[{x.upper().replace('SS', 'ẞ')}{x}A-Za-z][{x}a-z]*" for x in (ALPHABETS[k] for k in ("western", "polish", "czech", "turkish", "vietnamese")))
    + r"|[А-ЯЁЂ-Џа-яё][а-яёђ-џґ]*|[Α-ΩΆ-Ώα-ώ][α-ώ]*)[\])”\"'»’.,;:!?…]*"
)


@lru_cache(1 << 15)
def _rare_han(c: str) -> bool:
    """Outside the first levels of the national sets."""
    for codec, last in (("gb2312", 0xD7), ("shift_jis", 0x98)):
        try:
            if c.encode(codec)[0] <= last:
                return False
        except UnicodeEncodeError:
            pass
    return True


@lru_cache(1 << 15)
def _han_cost(c: str) -> float:
    """1 for a rare character, but little for one of the traditional set's first level."""
    if not _rare_han(c):
        return 0.0
    try:
        return 0.1 if c.encode("big5")[0] <= 0xC6 else 1.0
    except UnicodeEncodeError:
        return 1.0


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x370 or 0x1D00 <= o < 0x1DC0 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800 or 0xFB00 <= o < 0xFB07:
        return "any" if o == 0xB5 or 0x2B0 <= o < 0x370 else "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "cyrillic"
    if 0x3040 <= o < 0x3100 or 0x31F0 <= o < 0x3200:
        return "kana"
    if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0 or 0xF900 <= o < 0xFB00:
        return "han"
    if 0xFF61 <= o < 0xFFA0:
        return "half"
    if 0x2000 <= o < 0x3040 or o > 0xFFFF or 0xFF00 <= o < 0xFF61:
        return "any"  # letters used as signs
    return "other"


def _word_cost(word: str) -> float:
    low = word.lower()
    of = [_script(c) for c in low]
    scripts = set(of) - {"any"}
    cost = float(of.count("half"))
    if scripts & {"kana", "han"}:
        return cost + sum(_han_cost(c) for c, s in zip(low, of) if s == "han") + (0.5 if scripts - {"kana", "han", "half"} else 0)
    if len(scripts - {"half"}) > 1 and len(low) > 2:
        cost += 3.0 + 0.5 * min(of.count(s) for s in scripts - {"half"})
    if "latin" in scripts:
        latin = [c for c in unicodedata.normalize("NFC", low) if _script(c) == "latin"]
        if all(c in BYTE_LETTERS for c in latin):
            cost += min(sum(c not in s for c in latin) for s in SETS)
        marked = sum(c > "\x7f" for c in latin)
        if len(latin) >= 3 and marked == len(latin) and not set(latin) <= NORDIC and all(c in BYTE_LETTERS for c in latin):
            cost += 0.5 * marked
    # capitals after small letters
    if "cyrillic" in scripts and len(word) > 2 and word[0].islower() and word[1:].isupper():
        cost += 1
    cost += sum(a.isupper() and b.isupper() and c.islower() and a > "\x7f" and b > "\x7f" for a, b, c in zip(word, word[1:], word[2:]))
    cost += sum(a.islower() and b.isupper() and (a > "\x7f" or b > "\x7f") for a, b in zip(word, word[1:]))
    return cost


@lru_cache(1 << 18)
def token_cost(token: str) -> float:
    """0 for what is written so on purpose; grows with each sign of garbling."""
    if token.isascii() or PLAIN.fullmatch(token):
        return 0.0
    cost = 0.0
    n = len(token)
    for k, c in enumerate(token):
        if c <= "\x7f":
            continue
        o = ord(c)
        if 0x80 <= o < 0xA0 or o == 0xFFFD or 0xE000 <= o < 0xF900:
            cost += 2
            continue
        if c.isalpha() or c in JOINERS:
            continue
        kind = unicodedata.category(c)
        if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61 or o > 0xFFFF:
            continue
        if kind in ("Mn", "Mc", "Cf", "Nd"):
            continue
        before, after = k > 0 and token[k - 1].isalpha(), k + 1 < n and token[k + 1].isalpha()
        run = 1 if before and after else 2
        if (before or after) and kind in ("Sm", "No") and not (before and k > run and token[k - run - 1 : k].isalpha()) and not (after and k + run + 1 < n and token[k + 1 : k + run + 2].isalpha()):
            continue  # at one or two letters: quantities, powers, formulas
        if kind == "Zs":
            continue
        if before and after:
            cost += 1
        elif (before or after) and not (c in "¡¿" and not before) and not (c in "€£¥¢°©®™§№µ" and not before) and not (c in "²³¹" and k < 3) and c not in "®™©":
            cost += 0.75
        elif 0x2500 <= o < 0x25A0 and (before or after):
            cost += 1
    for w in LETTERS.findall(token):
        w = "".join(c for c in w if c.isalpha())
        if w and not w.isascii():
            cost += _word_cost(w)
    return cost


@lru_cache(1 << 18)
def sequences(token: str) -> float:
    """A cost for each character in what looks like sequences of UTF-8. In Cyrillic, where two letters can look so, from two sequences on."""
    if token.isascii():
        return 0.0
    found = [r.findall(token) for r in RUNS]
    return 1.5 * max(sum(map(len, x)) for x in (*found[:-1], found[-1] if len(found[-1]) > 1 else ()))


def _table(codec: str) -> dict[int, str]:
    """Characters of a one-byte encoding to that byte as a Latin-1 character; bytes it leaves open stand for themselves."""
    out = {k: "\uffff" for k in range(0x80, 0x100)}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = chr(b)
    return out


ONE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "cp866", "koi8-r", "cp1253", "iso8859-7", "cp1254", "iso8859-9", "iso8859-15", "cp1257", "cp1258", "mac_cyrillic", "cp852")
WIDE = ("cp932", "gbk", "big5", "euc_kr", "euc_jp")
TABLES = {c: _table(c) for c in ONE_BYTE}
BYTE_LETTERS = frozenset(LATIN) | {c.lower() for t in TABLES.values() for o in t if (c := chr(o)).isalpha() and o < 0x250 and len(c.lower()) == 1}
LEGACY = [
    *((a, b) for a in ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850") for b in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "cp1253", "iso8859-7", "cp932", "euc_jp", "gbk", "big5", "euc_kr")),
    *((a, b) for a in ("cp1252", "latin-1") for b in ("cp1250", "iso8859-2", "cp1254", "cp1258", "cp1257", "mac_roman", "cp437", "cp850", "cp852")),
    *((a, b) for a in ("cp1251", "koi8-r", "cp866", "mac_cyrillic") for b in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "cp1252", "cp1250", "cp1253", "gbk", "cp932") if a != b),
    *((a, b) for a in ("cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp1253", "cp1254", "cp1257") for b in ("cp1252", "cp1250", "iso8859-2", "cp852") if a != b),
    *((a, b) for a in ("cp932", "gbk", "big5", "euc_kr") for b in ("cp932", "euc_jp", "gbk", "big5", "euc_kr", "cp1252", "cp1251", "cp1250") if a != b),
]
# Code points of what texts are made of: those whose sequences of UTF-8 count as garbling when they stand as single characters
USUAL = ((0x80, 0x180), (0x192, 0x193), (0x1A0, 0x1B1), (0x218, 0x21C), (0x259, 0x25A), (0x2C6, 0x2DD), (0x386, 0x3CF), (0x401, 0x460), (0x490, 0x492), (0x5D0, 0x700), (0x900, 0x980), (0xE00, 0xE80), (0x1EA0, 0x1EFA), (0x2010, 0x2045), (0x20AC, 0x20AD), (0x2100, 0x2123), (0x2190, 0x2194), (0x2200, 0x2266), (0x3000, 0x30FF), (0x4E00, 0xA000), (0xAC00, 0xD7A4))


def _runs(codec: str) -> re.Pattern:
    """What sequences of UTF-8 look like when read in a one-byte encoding."""
    shown = {ord(b): chr(o) for o, b in TABLES[codec].items() if b < "\u0100"}
    group = lambda some: "[" + "".join(map(re.escape, some)) + "]"
    leads: dict[int, set[int]] = {}
    threes: dict[int, set[int]] = {}
    for first, last in USUAL:
        if (first > 0x2FFF or 0x500 < first < 0x1000) and codec not in PLAINEST or first > 0x491 and codec == "cp1251":
            continue  # letters of other encodings follow each other so
        for o in range(first, last):
            raw = chr(o).encode()
            (leads if len(raw) == 2 else threes).setdefault(raw[0], set()).add(raw[1])
    trail = group(shown[b] for b in range(0x80, 0xC0))
    parts = [re.escape(shown[a]) + group(shown[b] for b in sorted(x)) for a, x in leads.items()] + [re.escape(shown[a]) + group(shown[b] for b in sorted(x)) + trail for a, x in threes.items()]
    return re.compile("|".join(parts) + "|" + group(shown[b] for b in range(0xF0, 0xF5)) + trail + "{3}")


TWO = re.compile("[\x80-\u036f\u2000-\u2bff][^\x00-\x7f]")  # UTF-8 takes two bytes at least, the first of them a sign or a Latin letter in those below
SURE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")  # no word of any language decodes strictly from these by chance
PLAINEST = ("cp1252", "latin-1")
RUNS = [_runs(c) for c in (*PLAINEST, "mac_roman", "cp437", "cp850", "cp1250", "cp1251")]
OUTER = "“”„«»‘’‹›…–—()[]{}<>\"'.,;:!?"


def recode(token: str, read: str, written: str) -> str | None:
    """The token's bytes in the one encoding, strictly decoded in the other; null where that fails."""
    if "\ufffd" in token:
        return None
    try:
        table = TABLES.get(read)
        raw = token.translate(table).encode("latin-1") if table else token.encode(read)
        return raw.decode(written)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


@lru_cache(1 << 18)
def as_utf8(token: str) -> str:
    """The token as it was written in UTF-8, by the first encoding whose outcome is shorter and costs least, less than the token; else itself."""
    best, least = token, token_cost(token) + sequences(token)
    if not least:
        return token
    for core in dict.fromkeys((token, token.strip(OUTER))):
        if not core or core.isascii():
            continue
        for read in (*ONE_BYTE, *WIDE):
            new = recode(core, read, "utf-8")
            if new is None or len(new) > len(core) or len(new) == len(core) and (read in TABLES or new.count("\x00")):
                continue
            whole = token.replace(core, new, 1)
            if (cost := token_cost(whole) + sequences(whole)) < least:
                best, least = whole, cost
                if read in PLAINEST:
                    break
        if best != token:
            break
    if best == token and token[-1] in "ÂÃ" and len(token) > 1:  # a no-break space or à, whose second half was taken for a blank
        new = recode(token + "\xa0", "latin-1", "utf-8") or ""
        if new and token_cost(new) <= token_cost(token[:-1]) and new[-1] in "\xa0à":
            return new.rstrip("\xa0")
    return best


@lru_cache(1 << 18)
def gain(token: str, read: str, written: str) -> tuple[float, str]:
    """Cost that a candidate takes off the token, and the outcome; 0 and the token itself where none, or where the outcome has signs that no writer sets."""
    new = recode(token, read, written)
    if new is None or new == token or any(c > "\x7f" and not c.isalpha() and c not in USUAL_SIGNS and unicodedata.category(c)[0] != "M" for c in new):
        return 0.0, token
    drop = token_cost(token) - token_cost(new)
    return (drop, new) if drop > 0 else (0.0, token)


# Signs in texts beside letters.
USUAL_SIGNS = frozenset("’‘“”„«»‹›‚–—‐‑…·•€£¥¢°©®™§№µ¡¿²³¹½¼¾×±†‡¶\xa0\xad←→、。「」『』・ー！？：；（），～〜〈〉《》【】％＋－０１２３４５６７８９")
# Words that tell of a change, where a garbled word is quoted beside its right form.
CHANGE = frozenset("""instead rather turned turns became becomes into shows showed shown displays displayed appears appeared typed wrote reads mojibake garbled encoding
    statt anstatt wurde wird erscheint zeigt getippt lieu devient devenu affiche apparaît tapé vez aparece muestra lugar convierte zamiast zmienia wyświetla
    вместо стало превратилось показывает invés mostra místo zobrazuje yerine gösterir αντί""".split())
SENTENCE = re.compile(r"[.!?…][\"”»’')\]]*$")
LEAST_GAIN = 1.5  # from here the sum over a text is evidence; below, tokens must tell for themselves
MARKS = "†‡¹²³§¶°±×÷µ©®™"
POLISH, SPANISH = frozenset(ALPHABETS["polish"]), frozenset("áéíñóúü")
WITHIN = str.maketrans("µ×÷", "uxx")
HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
INSIDE = re.compile(r"[^\W\d_][^\x00-\x7f][^\W\d_]")


def _quoted(tokens: list[str], at: int, right: str) -> bool:
    """Does the right form stand in the same sentence, and a word that tells of a change? Then the text tells of the garbling."""
    core = right.strip(OUTER)
    if sum(map(str.isalpha, core)) < 2:
        return False
    begin = end = at
    while begin > 0 and not SENTENCE.search(tokens[begin - 1]):
        begin -= 1
    while end + 1 < len(tokens) and not SENTENCE.search(tokens[end]):
        end += 1
    near = [t.strip(OUTER) for t in tokens[begin : end + 1]]
    return core in near and any(t.lower() in CHANGE for t in near)


def _letters(token: str) -> frozenset[str]:
    return frozenset(c for c in token.lower() if c > "\x7f" and c.isalpha())


@lru_cache(1 << 16)
def _tells(token: str, new: str) -> bool:
    """Is the outcome a usual word, and the token no such word with a sign that writers set there?"""
    if token_cost(new) or not token_cost(token.strip(MARKS + OUTER).translate(WITHIN)):
        return False
    if sum(map(_rare_han, filter(HAN.match, token))) == 1:
        return False  # names hold rare characters
    if (own := _letters(token)) and own <= SLAVIC and all(w[1:].islower() or w.isupper() or len(w) == 1 for w in LETTERS.findall(token)):
        return False  # languages with letters beside the Russian
    words = [w for w in LETTERS.findall(new) if not w.isascii()]
    return bool(words) and not set("ªº").intersection(new) and all(HAN.match(w) or len(w) > 2 and (w.islower() or w[1:].islower() or w.isupper()) for w in words)


def _fits(new: str, others: list[frozenset[str]]) -> bool:
    """Do most of the other words share an alphabet with the outcome?"""
    own = _letters(new)
    if any(map(HAN.match, own)):
        return 2 * sum(any(map(HAN.match, x)) for x in others) > len(others)
    return any(3 * sum(x <= s for x in others) >= 2 * len(others) for s in (*SETS, RUSSIAN, GREEK) if own <= s)


def _telling(turned: dict[str, str], pair: tuple[str, str], tokens: list[str], many: dict[str, list[int]], text: str) -> dict[str, str]:
    """Those of the turned tokens that tell for themselves: of their line's alphabet, or of the text's, as it stands or turned by the same pair;
    where no other word has letters beyond a-z, of any alphabet, if letters stand on either side of what was turned.
    """
    out = {t: new for t, new in turned.items() if _tells(t, new) and not all(_quoted(tokens, k, new) for k in many[t])}
    if not out:
        return out
    near = lambda some: [x for t in some if t not in turned and not token_cost(t) and (x := _letters(t))]
    everywhere = near(many)
    if any(x - POLISH for x in everywhere) and all(x <= SPANISH for x in everywhere):
        out = {t: new for t, new in out.items() if token_cost(re.sub("[¿¡]", " ", t))}  # a question without a blank before it
    after = [_letters(recode(t, *pair) or t) for t in many if t not in turned and not token_cost(t) and _letters(t)]
    lines = [set(TOKEN.findall(line)) for line in text.split("\n")] if everywhere else []
    fit = lambda t, new: _fits(new, everywhere) or _fits(new, after) or any(_fits(new, x) for line in lines if t in line and (x := near(line)))
    return {t: new for t, new in out.items() if (fit(t, new) if everywhere else INSIDE.search(t) and any(_letters(new) <= s for s in (*SETS, RUSSIAN, GREEK)))}


def _same_reading(found: dict[str, str], many: dict[str, list[int]]) -> dict[str, str]:
    """Tokens beside those found in UTF-8 that decode too, at no cost, from the encoding that most of these were read in."""
    some = list(found.items())[:50]  # enough to tell the encoding; every token is tried with it
    if len(some) < 3:
        return {}
    votes = {read: sum(recode(t, read, "utf-8") == new for t, new in some) for read in (*ONE_BYTE, *WIDE)}
    read = max(votes, key=votes.__getitem__)
    if 2 * votes[read] < len(some):
        return {}
    return {t: new for t in many if t not in found and (new := recode(t, read, "utf-8")) and len(new) < len(t) and token_cost(new) <= token_cost(t)}


def _repairs(text: str) -> tuple[dict[str, str], dict[str, str], bool]:
    """Of one layer of garbling: tokens whose cost drops, with what they were; tokens that the same candidate turns at no cost; and
    whether most of the text is garbled so.
    """
    tokens = TOKEN.findall(text)
    many: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        if not t.isascii():
            many.setdefault(t, []).append(k)
    found = {t: new for t in many if (new := as_utf8(t)) != t}
    for t in [t for t, new in found.items() if all(_quoted(tokens, k, new) for k in many[t])]:
        del found[t], many[t]
    foreign = [t for t, new in found.items() if len(t) - len(new) < 2 and any(_script(c) in ("greek", "cyrillic") for c in new if c.isalpha())]
    if len(foreign) == 1 and sum([any(_script(c) in ("greek", "cyrillic") for c in t) for t in many]) == 0 and len(found) == 1:
        del found[foreign[0]]  # one letter of another script, in a text without it, is chance
    costly = [t for t in many if token_cost(t) > 0 and "\ufffd" not in t]
    rest = sum([token_cost(t) * len(many[t]) for t in costly if t not in found])
    taken = sum((token_cost(t) + sequences(t) - token_cost(new) - sequences(new)) * len(many[t]) for t, new in found.items())
    same = _same_reading(found, many)
    if not rest or found and (rest <= taken or rest < LEAST_GAIN):
        return found, same, False
    best, chosen, out, sure, usual = taken, None, found, True, 0.0
    for read, written in LEGACY:
        total, new = 0.0, {}
        for t in costly:
            drop, to = gain(t, read, written)
            if drop:
                total += drop * len(many[t])
                new[t] = to
        many_tell = total >= LEAST_GAIN and (len(new) > 1 or total >= 2 or len(many) == 1)
        if total > best - (1e-9 if chosen else -1e-9) and not many_tell:
            new = _telling(new, (read, written), tokens, many, text)
            total = sum((token_cost(t) - token_cost(to)) * len(many[t]) for t, to in new.items())
        if total > best - 1e-9 and new and (total > best + 1e-9 or chosen):
            common = sum(sum([c in COMMON for c in to.lower()]) * len(many[t]) for t, to in new.items())
            if total > best + 1e-9 or common > usual:
                best, chosen, out, sure, usual = total, (read, written), new, many_tell, common
    if chosen is None:
        return found, same, False
    even = {t: new for t in many if t not in out and (new := recode(t, *chosen)) is not None and new != t and token_cost(new) <= token_cost(t)}
    right = [x for new in out.values() if (x := _letters(new))]
    misfits = {t: new for t, new in even.items() if not _fits(t, right) and _fits(new, right)}  # those that their alphabet does not fit as they stand
    if not sure:
        even = misfits
    elif len(out) > 2:
        out = misfits | out
    return out, even, sure and 2 * sum(len(many[t]) for t in out) > sum(map(len, many.values()))


def _turn(text: str, found: dict[str, str], even: dict[str, str], most: bool) -> str:
    """Puts in what the tokens were. Tokens that turn at no cost do so on lines that hold a garbled one, or everywhere where most are."""
    if not even:
        return TOKEN.sub(lambda m: found.get(m[0], m[0]), text)
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if most or any(t in found for t in TOKEN.findall(line)):
            lines[k] = TOKEN.sub(lambda m: found.get(m[0]) or even.get(m[0], m[0]), line)
    return "\n".join(lines)


def examine(text: str | None) -> tuple[bool, str | None, int, bool]:
    """(garbled, restored text, layers taken off, whole). A text that is no case is given back as it is, with whole true.

    Layers are taken off until no token's cost drops, or a text comes back. A garbled text is whole when no cost is left, but for signs that
    writers set at words: lost characters, and pieces that no pair of encodings turns. Null gives null.
    """
    if not text or text.isascii():
        return False, text, 0, True
    now, layers, seen = text, 0, {text}
    while (step := _repairs(now))[0] and (new := _turn(now, *step)) not in seen:
        now = new
        seen.add(now)
        layers += 1
    garbled = layers > 0 or "\ufffd" in now
    return garbled, now, layers, not (garbled and any(token_cost(t.strip(MARKS + OUTER).translate(WITHIN)) for t in TOKEN.findall(now) if not t.isascii()))


def repaired(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, garbled, layers, whole, restored) for each row of the input; ``restored`` is null where nothing was wrong.

    Null, empty and plain ASCII texts are no case. Repeated rows give repeated rows. Texts are read whole.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        seen = [examine(t) for t in x["text"]]
        return {"key": x["key"], "garbled": [s[0] for s in seen], "layers": [s[2] for s in seen], "whole": [s[3] for s in seen], "restored": [s[1] if s[0] else None for s in seen]}

    kind = dict(texts.dtypes)[key]
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return map_rows(rows, run, f"key {kind}, garbled boolean, layers int, whole boolean, restored string").withColumnRenamed("key", key)


def garbled_keys(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the garbled texts, restorable or not."""
    kind = dict(texts.dtypes)[key]
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return map_rows(rows, lambda x: {"key": [k for k, t in zip(x["key"], x["text"], strict=True) if examine(t)[0]]}, f"key {kind}").withColumnRenamed("key", key)
