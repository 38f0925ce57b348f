"""HTML to text, and text to terms, as built-in column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that part terms. Tab, * _ $ ~ ` \ and typographic quotes do not.
DELIMITERS = " .,\";'\n\r:=-+/()[]{}#^@!?><&%|"

# Pieces of a page: text, a tag, what leaves no text (a comment, a document type, a script or style with its content), or a sign that begins no tag. What is not closed goes on to the end of the page.
PIECE = r"(?s)[^<]+|<(?![sS!])[a-zA-Z/?][^>]*(?:>|\z)|<!--.*?(?:-->|\z)|(?i:<(script|style)\b)[^>]*>.*?(?:(?i:</\1)\s*>|\z)|<[a-zA-Z/!?][^>]*(?:>|\z)|<"
PARAGRAPH = r"^<[pP](?:[\s/>]|$)"
BLOCK = r"(?i)^</?(?:div|li|td|th|tr|h[1-6]|br|ul|ol|table|section|article|blockquote)\b"
BLANK = r"^[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*$"
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Named character references of HTML 4, and the apostrophe, to their code points.
NAMES = {**name2codepoint, "apos": 39}

# Fixed value: what counts as a link of the raw page.
HREF = r'(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"'
NOINDEX = r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"']?robots\b)(?=[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*\bnoindex\b)[^>]*>"


def hrefs(html: Column) -> Column:
    """All double-quoted link targets of the raw page, in order; entities are left as they are. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), F.array().cast("array<string>"))


def has_noindex(html: Column) -> Column:
    """Does a robots meta tag forbid indexing? Null gives false."""
    return F.coalesce(html.rlike(NOINDEX), F.lit(False))


def _reference(piece: Column) -> Column:
    """What follows an ampersand, with the character that it names; as it stands where it names none."""
    name = F.regexp_extract(piece, REFERENCE, 1)
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    code = (
        F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int"))
        .when(name.startswith("#"), F.substring(name, 2, 7).cast("int"))
        .when(name != "", F.try_element_at(names, name))
    )
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(good, F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))


def unescape(text: Column) -> Column:
    """Character references, by name or number, decoded once: ``&amp;lt;`` gives ``&lt;``. Unknown ones, and those without a semicolon, stay."""
    pieces = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(_reference(p)))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def html_to_text(html: Column, block_separators: bool = False) -> Column:
    """Text of a page: comments, scripts, styles and tags dropped, each ``<p>`` begins a line, other tags leave no gap, text of white space alone is left out.

    ``block_separators`` adds a line break at each block tag. A comment, script, style or tag that is not closed goes on to the end of the page. Null gives null, empty gives empty.
    """

    def text_of(x: Column) -> Column:
        tag = F.when(x.rlike(PARAGRAPH), "\r\n")
        if block_separators:
            tag = tag.when(x.rlike(BLOCK), "\n")
        return F.when(~x.startswith("<"), F.when(x.rlike(BLANK), "").otherwise(unescape(x))).when(x == "<", x).otherwise(tag.otherwise(""))

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), text_of), "")


def tokens(text: Column) -> Column:
    """Lower-case terms of a text, in order, repeated ones included. Null and empty give an empty array."""
    escaped = "".join("\\" + c if c in r"\[]^-&" else c for c in DELIMITERS)
    return F.coalesce(F.filter(F.split(F.lower(text), f"[{escaped}]+"), lambda x: x != ""), F.array().cast("array<string>"))
