"""Text clean-up and sentence splitting as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters one Unicode-aware "whitespace" class covers, and the
# two broken characters that stand for an em dash in badly decoded exports.
WHITESPACE = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters, for what looks at them one by one.
WHITESPACE_CHARACTERS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BROKEN_DASHES = "\u0097�"
EM_DASH = "—"


def clean_text(text: Column) -> Column:
    dashed = text
    for broken in BROKEN_DASHES:
        dashed = F.replace(dashed, F.lit(broken), F.lit(EM_DASH))
    return F.trim(F.regexp_replace(dashed, WHITESPACE + "+", " "))


def split_sentences(text: Column) -> Column:
    """array<string>: cut at whitespace after . ! or ?; a text without content stays whole.

    A cut needs a mark in front of it and takes all whitespace behind it, so no part of a trimmed text
    is empty, and one without content is its own only part. The text is trimmed without a regular
    expression, which would look for the end again at each whitespace, and cut once.
    """
    stripped = F.btrim(text, F.lit(WHITESPACE_CHARACTERS))
    return F.split(stripped, f"(?<=[.!?]){WHITESPACE}+")


def has_content(text: Column) -> Column:
    """clean_text(text) is not empty; stops at the first character that counts."""
    return F.regexp_like(text, F.lit(WHITESPACE.replace("[", "[^", 1)))


def words(text: Column) -> Column:
    """Lower-case ASCII words; everything else separates them in any language.

    Found, not split off: split compiles its pattern anew for each row.
    """
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower (initcap would touch every word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
