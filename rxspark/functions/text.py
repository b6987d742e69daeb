"""Cleaning and normalisation expressions (built-in functions, JVM side)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from rxspark.rules import NUMBER_WORDS

NBSP = " "
ZERO_WIDTH = "​"
# Text made only of these characters is already in composed form.
MAY_NEED_NFC = r"[^\u0000-˿‐-‧€]"


# every white-space character, one by one: trimming a set is far cheaper than a pattern
WHITE_SPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (plain ``trim`` drops spaces only)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def capitalize(c: Column) -> Column:
    """First letter upper, all others lower (``initcap`` would change every word)."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def compose(c: Column) -> Column:
    """NFC. Only texts holding characters that can change are sent to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(MAY_NEED_NFC), c)), c)


def clean_text(c: Column, nfc: bool = True) -> Column:
    c = F.translate(F.translate(c, NBSP, " "), ZERO_WIDTH, "")
    if nfc:
        c = compose(c)
    c = F.regexp_replace(c, r"[\r\t\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return blank_to_null(strip(F.regexp_replace(c, r" {2,}", " ")))


def parse_price(c: Column) -> Column:
    number = F.regexp_extract(F.translate(c, NBSP, ""), r"(\d+(?:[.,]\d+)?)", 1)
    return F.translate(blank_to_null(number), ",", ".").cast("float")


def clean_toxicity(c: Column) -> Column:
    v = F.upper(strip(c))
    return F.when(~v.isin("AUCUN", "AUCUNE", ""), v)


def normalize_min_age(c: Column) -> Column:
    base = F.regexp_replace(strip(c), r"\.+$", "")
    text = F.lower(base)
    for word, number in NUMBER_WORDS.items():
        text = F.regexp_replace(text, rf"(?U)\b{word}\b", str(number))
    found = r"(\d+)\s*(ans?|mois)"
    quantity = F.regexp_replace(F.regexp_extract(text, found, 1), r"^0+(?=\d)", "")
    unit = F.when(F.regexp_extract(text, found, 2) == "mois", "mois").otherwise("ans")
    return F.when(quantity != "", F.concat_ws(" ", quantity, unit)).otherwise(
        blank_to_null(strip(base))
    )


def parse_flag(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("oui", "yes", "true", "1"), F.lit(False))


def clean_status(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "Commercialisé").otherwise(strip(c))


def clean_atc(c: Column) -> Column:
    return F.upper(F.trim(c))


def clean_link(c: Column, nfc: bool = True) -> Column:
    placeholder = F.lower(F.trim(c)).isin("cliquez ici", "click here", "")
    return F.when(~placeholder, clean_text(c, nfc))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def molecule_key(c: Column) -> Column:
    return F.lower(strip(c))


def _accent_table() -> tuple[str, str]:
    """Every Latin letter whose canonical decomposition is one letter plus marks."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(
            ch for ch in unicodedata.normalize("NFD", letter) if unicodedata.category(ch) != "Mn"
        )
        if base != letter and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def thesaurus_key(c: Column) -> Column:
    return strip_accents(F.upper(strip(c)))


def split_list(c: Column) -> Column:
    """Comma separated text to an array without blank items; null gives an empty array."""
    items = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def number_text(c: Column) -> Column:
    """A double as it is usually printed: no exponent, at least one decimal."""
    plain = F.regexp_replace(
        F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    return F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).otherwise(plain)
