"""Column functions over text: all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyzer's token, after the word boundary rules of Unicode: letters, marks, digits and underscores, with
#: a full stop, colon or apostrophe between two letters and a full stop, comma, semicolon or apostrophe between two digits.
_LETTER, _DIGIT = r"[\p{L}\p{M}]", r"\p{Nd}"
_UNIT = rf"{_LETTER}(?:[.:'’·]{_LETTER})*|{_DIGIT}(?:[.,;'’]{_DIGIT})*|\p{{N}}"
TOKEN = rf"_*(?:{_UNIT})(?:{_UNIT}|_)*"
#: The same for Java: a run of letters or digits is one step, nothing is given back, and ASCII is tried first.
_LETTERS, _DIGITS = r"[a-z[\p{L}\p{M}]]++", r"[0-9[\p{Nd}]]++"
_RUN = rf"{_LETTERS}(?:[.:'’·]{_LETTERS})*+|{_DIGITS}(?:[.,;'’]{_DIGITS})*+|\p{{N}}"
TOKEN_RUNS = rf"_*(?:{_RUN})(?:{_RUN}|_)*+"
#: White space, Unicode's too, inside a class.
SPACE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A run of anything else. Printing ASCII comes first, as the rest of the class is tried a range at a time.
WORD = f"[!-~[^{SPACE}]]+"


#: Ideographs and hiragana, inside a class: each is a word of its own. Katakana, hangul and Thai stay in runs.
SINGLE = "\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3041-\u309f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


#: One of them, for Java: below the first of them no range is tried.
ANY_SINGLE = rf"[\u2e80-\x{{10FFFF}}&&[{SINGLE}]]"


def tokens(text: Column) -> Column:
    """The jargon analyzer: lower-cased words as a standard tokenizer has them; no stemming, no stop words."""
    apart = F.when(text.rlike(ANY_SINGLE), F.regexp_replace(text, f"([{SINGLE}])", " $1 ")).otherwise(text)
    return F.regexp_extract_all(F.lower(apart), F.lit(TOKEN_RUNS), F.lit(0))


def slug(heading: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, no dash at the ends; may be empty."""
    return F.btrim(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), F.lit("-"))


def lines(text: Column) -> Column:
    """The lines of a text; a final line break ends the last line, it doesn't begin another."""
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    return F.split(F.when(F.endswith(text, F.lit("\n")), F.regexp_replace(text, r"\n\z", "")).otherwise(text), "\n")


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def rstrip(text: Column) -> Column:
    return F.when(F.right(text, F.lit(1)).between("!", "~"), text).otherwise(F.regexp_replace(text, f"[{SPACE}]+$", ""))


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def header_key(text: Column) -> Column:
    """A header for look-up: white space collapsed, upper case, without what comes before the first 0-9 or A-Z."""
    return F.regexp_replace(F.upper(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))), "^[^0-9A-Z]+", "")


def unit_number(unit: Column) -> Column:
    return F.regexp_extract(F.trim(unit), r"^(\d+)([A-Z]*)$", 1)


def unit_variant(unit: Column) -> Column:
    return F.regexp_extract(F.trim(unit), r"^(\d+)([A-Z]*)$", 2)


def content_hash(prefix: Column, text: Column) -> Column:
    return F.sha2(F.concat(prefix, F.lit("\n\n"), text), 256)
