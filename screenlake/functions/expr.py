"""Small column expressions that several operators share."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def as_count(value: Column) -> Column:
    return value.cast("bigint")


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a proportion, in percent; NULL for n = 0."""
    p = F.try_divide(hits, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z / 2), n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    return 100 * (centre - half) / d, 100 * (centre + half) / d


def percent(hits: Column, n: Column) -> Column:
    return 100 * F.try_divide(hits, n)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents, other characters kept; ``fold_accents_full`` covers all of Unicode."""
    return F.translate(text, ACCENTED, PLAIN)


@cache
def ascii_parts() -> dict[str, str]:
    """The ASCII part of the compatibility decomposition of each other character that has one."""
    parts = ((chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    return {c: p for c, p in parts if p}


def character_set(characters: list[str]) -> str:
    """A pattern's set of these characters, as ranges."""
    codes = sorted(map(ord, characters))
    starts = [i for i, c in enumerate(codes) if not i or c > codes[i - 1] + 1]
    runs = [codes[a:b] for a, b in zip(starts, [*starts[1:], len(codes)])]
    return "[" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs) + "]"


def fold_accents_full(text: Column) -> Column:
    """NFKD, then only what is ASCII, with native functions and the table of ``ascii_parts``.

    Characters with one ASCII character are translated. The few that have several (ligatures, fractions, units) are
    replaced one after another, those that a text has; the rest goes. A text of ASCII only stays as it is.
    """
    parts = ascii_parts()
    one = {c: p for c, p in parts.items() if len(p) == 1}
    several = {c: p for c, p in parts.items() if len(p) > 1}
    table = F.create_map(*[F.lit(x) for cp in several.items() for x in cp])
    there = F.array_distinct(F.regexp_extract_all(text, F.lit(character_set(list(several))), F.lit(0)))
    spelt = F.aggregate(there, text, lambda t, c: F.replace(t, c, F.element_at(table, c)))
    folded = F.regexp_replace(F.translate(spelt, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def zero_padded(code: Column, width: int) -> Column:
    """Leading zeros up to ``width``, never truncating."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def normal_label(label: Column, kept: tuple[str, ...] = ("T", "F")) -> Column:
    """Trimmed, upper case; blanks and labels that aren't kept are NULL."""
    text = F.upper(F.trim(label))
    return F.when(text.isin(*kept), text)


def recode(value: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def trimmed(text: Column, ratio: Column, least: int = 1200) -> Column:
    """The first part of ``text``: a ratio of 0.01 to 1 of it, at least ``least`` characters."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.01), ratio))
    size = F.least(F.length(text), F.greatest(F.lit(least), F.floor(F.length(text) * share).cast("int")))
    return F.substring(text, F.lit(1), size)


def token_estimate(text: Column) -> Column:
    """About one token for four characters."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def bin_label(low: Column, high: Column, last: Column) -> Column:
    show = lambda c: F.format_string("%.2f", c)
    return F.concat(F.lit("["), show(low), F.lit(", "), show(high), F.when(last, F.lit("]")).otherwise(F.lit(")")))


def moment(date: Column, time: Column) -> Column:
    """The timestamp of a date and a time given as text; NULL where they aren't one."""
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), time.cast("string")), F.lit("yyyy-MM-dd HH:mm:ss"))
