"""Which captured label values are real data, and what shape a value must have."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import ascii_pattern, is_ascii, let, strip


def _precomposed_letters() -> tuple[str, str]:
    """Source and target letters for ``translate``: every precomposed Latin letter with
    marks in the blocks Vietnamese uses, mapped to its base letter."""
    src, dst = ["Đ", "đ"], ["D", "d"]
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            flat = "".join(m for m in unicodedata.normalize("NFD", letter) if not unicodedata.combining(m))
            if len(flat) == 1 and flat != letter:
                src.append(letter)
                dst.append(flat)
    return "".join(src), "".join(dst)


_MARKED, _PLAIN = _precomposed_letters()


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks (EXV6): precomposed letters through ``translate``,
    combining marks of decomposed text removed."""
    plain = F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{M}+", "")
    # a text of one byte for each character is ASCII and has no marks
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(plain)


# more than six letters, all of them capitals
_SHOUTED_TITLE = r"^(?:\P{L}*\p{Lu}){7,}\P{L}*$"
_AU_ONLY = [V.ANGLE_PLACEHOLDER, V.CURLY_PLACEHOLDER]
_ALWAYS = [
    "^$",
    V.FILLER_START,
    V.BRACKET_PLACEHOLDER,
    f"(?iU)^(?:{'|'.join(V.GENERIC_ROLES)})$",
    _SHOUTED_TITLE,
]
# what BOILERPLATE finds in ASCII: its other phrases have letters with marks only
_ASCII_BOILERPLATE = r"(?=[tTmMpP])(?i:thong\s*tu\s*so|mau\s*so|phu\s*luc)"


def clean_value(c: Column, locale: str = "au") -> Column:
    """The stripped value, or NULL when it is a placeholder, a title, boilerplate or text
    bled over from another label (CLN1).

    The tests of how the text begins form one pattern, tried at its start alone.
    """
    return let(strip(c), lambda v: F.when(is_data(v, locale), v))


def is_data(v: Column, locale: str = "au") -> Column:
    """The test of ``clean_value`` on a stripped value."""
    begins = [p.replace("^", "", 1) for p in [*(_AU_ONLY if locale == "au" else []), *_ALWAYS]]
    refused = v.rlike("^(?:" + "|".join(f"(?:{p})" for p in begins) + ")") | v.contains(":")
    ascii_refused = v.rlike(_ASCII_BOILERPLATE) | v.rlike(ascii_pattern(V.PLACEHOLDER_NAME))
    return ~(refused | F.when(is_ascii(v), ascii_refused).otherwise(v.rlike(V.BOILERPLATE) | strip_diacritics(v).rlike(V.PLACEHOLDER_NAME)))


def looks_like_name(c: Column) -> Column:
    """2-5 words, at most 60 characters, not all capitals, none of ``. ; :`` (EXT9)."""
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    cased = F.upper(c) != F.lower(c)
    shouting = cased & (F.upper(c) == c)
    return F.coalesce(
        (F.length(c) > 0) & (F.length(c) <= 60) & ~shouting & ~c.rlike(r"[.;:]") & words.between(2, 5),
        F.lit(False),
    )


def looks_like_bsb(c: Column) -> Column:
    """At most 20 characters, at least four digits, no ASCII letters (EXT9)."""
    digits = F.length(F.regexp_replace(c, r"(?U)\D+", ""))
    return F.coalesce(
        (F.length(c) > 0) & (F.length(c) <= 20) & (digits >= 4) & ~c.rlike("[A-Za-z]"), F.lit(False)
    )


def looks_like_address(c: Column) -> Column:
    """At most 100 characters with a state and a four-digit postcode (EXT9)."""
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= 100) & c.rlike(V.ADDRESS_SHAPE), F.lit(False))
