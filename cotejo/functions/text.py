"""Text functions of the catalogue as Column -> Column expressions.

There are three normalisations, and they differ: ``normalize_key`` is the canonical key,
``normalize_general`` keeps dots and hyphens and turns accented letters into blanks, and
``normalize_equipment`` also maps abbreviations, synonyms and units.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that mean the same.
UNITS = {"cv": "hp", "hp": "hp", "kva": "kva", "kw": "kw", "v": "v", "volts": "v", "hz": "hz"}

# Abbreviations that the golden cases need; callers pass their own dictionary.
ABBREVIATIONS = {
    "asp": "aspirador",
    "apa": "aspirador de po e agua",
    "bld": "balde",
    "vassouras": "vassoura nylon, vassoura piacava, vassoura feiticeira, vassoura de teto, vassourao",
    "hidrojat": "hidrojateadora de alta pressao",
}

# Words of the trade and what they stand for.
DOMAIN_SYNONYMS = {
    "hidrojateadora": "lavadora alta pressao",
    "hidrojat": "hidrojateadora",
    "lav": "lavadora",
    "lav piso": "lavadora de piso",
    "scrubber": "lavadora de piso",
    "scrubber dryer": "lavadora de piso",
    "floor scrubber": "lavadora de piso",
    "politriz": "enceradeira",
    "polisher": "enceradeira",
    "floor polisher": "enceradeira",
    "vacuum": "aspirador",
    "industrial vacuum": "aspirador industrial",
    "vacuum cleaner": "aspirador",
    "extractor": "extratora",
    "carpet extractor": "extratora",
    "psi": "psi",
    "bar": "bar",
    "in": "pol",
    "inch": "pol",
    "inches": "pol",
    "ø": "diametro",
}


@cache
def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is an ASCII letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, *_folding()), "[\\u0300-\\u036f]", "")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_key(x: Column) -> Column:
    """Lower case without accents; letters, digits and single blanks only."""
    return collapse(F.regexp_replace(strip_accents(F.lower(x)), r"[^a-z0-9\s]", " "))


def sanitize(x: Column) -> Column:
    """Like the key but with case and underscores."""
    return collapse(F.regexp_replace(strip_accents(x), r"[^A-Za-z0-9_\s]", " "))


def normalize_general(x: Column) -> Column:
    """Lower case; anything but ASCII letters, digits, dots and hyphens becomes a blank; the end isn't trimmed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(x)), r"[^a-z0-9\s.\-]", " "), r"\s+", " ")


def consonant_key(x: Column) -> Column:
    return F.substring(F.regexp_replace(normalize_key(x), r"[aeiou\s]", ""), 1, 10)


def words(x: Column, pattern: str = r"\s+") -> Column:
    """The non-empty parts of a text; an empty array for null."""
    return F.coalesce(F.filter(F.split(x, pattern), lambda t: t != ""), F.array().cast("array<string>"))


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` gives for a value that is computed once a row, however often it is named."""
    return F.transform(F.array(x), make)[0]


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in entries.items() for v in pair])


def singular(token: Column) -> Column:
    size = F.length(token)
    return (
        F.when(size <= 3, token)
        .when(token.endswith("es") & (size > 4), F.substring(token, F.lit(1), size - 2))
        .when(token.endswith("s"), F.substring(token, F.lit(1), size - 1))
        .otherwise(token)
    )


def join_units(x: Column) -> Column:
    """Puts a number and the unit after it together; decimals have lost their point before."""
    joined = F.regexp_replace(x, r"(\d+[.,]?\d*)\s*(kva|kw|hp|cv|v|hz)\b", "$1$2")
    return F.regexp_replace(joined, r"(\d)cv\b", "$1hp")


def normalize_equipment(x: Column, abbreviations: dict = ABBREVIATIONS, synonyms: dict = DOMAIN_SYNONYMS, units: dict = UNITS) -> Column:
    """Key form with units joined and each token mapped: abbreviation, else synonym, else unit, else singular."""
    clean = F.regexp_replace(strip_accents(F.lower(x)), r"[^a-z0-9\s]", " ")
    tokens = words(collapse(join_units(clean)), " ")
    short, other, unit = literal_map(abbreviations or {"": ""}), literal_map(synonyms or {"": ""}), literal_map(units)
    plain = lambda v: collapse(F.regexp_replace(F.lower(v), r"[^a-z0-9\s]", " "))

    def mapped(token: Column) -> Column:
        base = F.when(F.map_contains_key(short, token), token).otherwise(singular(token))
        return F.coalesce(plain(short[base]), plain(other[base]), unit[base], base)

    return F.coalesce(F.array_join(F.filter(F.transform(tokens, mapped), lambda t: t != ""), " "), F.lit(""))


def consonant_signature(x: Column, **dictionaries: dict) -> Column:
    norm = normalize_equipment(x, **dictionaries)
    return F.concat(F.substring(F.regexp_replace(norm, "[^b-df-hj-np-tv-z]", ""), 1, 12), F.lit("_"), F.regexp_replace(norm, r"\D", ""))


def expansion_variants(x: Column, abbreviations: dict = ABBREVIATIONS) -> Column:
    """The items of all comma lists that tokens abbreviate, distinct and in order."""
    tokens = words(collapse(F.regexp_replace(strip_accents(F.lower(x)), r"[^a-z0-9\s]", " ")), " ")
    lists = {k: v for k, v in abbreviations.items() if "," in v} or {"": ","}
    found = F.filter(F.transform(tokens, lambda t: literal_map(lists)[t]), lambda v: v.isNotNull())
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda v: F.transform(F.split(v, ","), lambda i: F.trim(i)))), lambda v: v != ""))


def preprocess(x: Column) -> Column:
    return collapse(F.lower(x))


def simple_tokens(x: Column) -> Column:
    return words(F.regexp_replace(strip_accents(F.lower(x)), "[^a-z0-9]", " "))


def bm25_tokens(x: Column) -> Column:
    """Lower case, cut at white space; accents and punctuation stay."""
    return words(F.lower(x), r"(?U)\s+")


def _windows(size: Column, n: int, make: Callable[[Column, int], Column]) -> Column:
    """What ``make`` gives for each place of a window of n; none where there are fewer."""
    empty = F.array().cast("array<string>")
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: make(i, n))).otherwise(empty)


def char_ngrams(x: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of each word with a blank at either side, shortest first; shorter words give none."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.flatten(F.array(*[_windows(F.length(padded), n, lambda i, m: F.substring(padded, i, F.lit(m))) for n in range(low, high + 1)]))

    return F.flatten(F.transform(words(preprocess(x), " "), of_word))


def word_ngrams(x: Column, low: int = 1, high: int = 2) -> Column:
    tokens = simple_tokens(x)
    return F.flatten(F.array(*[_windows(F.size(tokens), n, lambda i, m: F.array_join(F.slice(tokens, i, F.lit(m)), " ")) for n in range(low, high + 1)]))


def split_alphanumeric(x: Column) -> Column:
    apart = F.regexp_replace(F.regexp_replace(x, "(?i)([0-9]+)([a-z]+)", "$1 $2"), "(?i)([a-z]+)([0-9]+)", "$1 $2")
    return collapse(F.lower(apart))


def model_numbers(x: Column) -> Column:
    """The first run of three or more digits in each token."""
    return model_numbers_of(words(normalize_key(x), " "))


def model_numbers_of(tokens: Column) -> Column:
    """Like ``model_numbers``, of the tokens of a key."""
    return F.filter(F.transform(tokens, lambda t: F.regexp_extract(t, r"\d{3,}", 0)), lambda n: n != "")


def numeric_tokens(x: Column) -> Column:
    return F.array_distinct(model_numbers(x))


def leading_number(x: Column) -> Column:
    """The number that a text begins with, as a lenient parser reads it; null if there is none."""
    return F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def parse_br_number(x: Column) -> Column:
    """Points are thousands, the comma is the decimal point: "1.234,56" is 1234.56, "1234.56" is 123456."""
    return leading_number(F.regexp_replace(F.replace(x, F.lit("."), F.lit("")), ",", "."))


def parse_brl(x: Column) -> Column:
    """A price in reais, or 0 where there is none; a comma with one or two digits at the end is decimal."""
    trimmed = F.trim(x)
    bare = F.trim(F.regexp_replace(trimmed, r"R\$\s*", ""))
    decimal = F.regexp_like(bare, F.lit(r",\d{1,2}$"))
    text = F.when(decimal, F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), ",", ".")).otherwise(F.regexp_replace(bare, r",(?=\d{3})", ""))
    number = leading_number(text)
    return F.when(trimmed.isin("", "-", "N/A", "null") | (number < 0), 0.0).otherwise(F.coalesce(number, F.lit(0.0)))


def format_brl(x: Column) -> Column:
    """pt-BR currency with a no-break space; null and NaN are zero."""
    value = F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x)
    digits = F.translate(F.format_number(F.abs(value), 2), ",.", ".,")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("R$\u00a0"), digits)


def is_brl_format(x: Column) -> Column:
    return F.regexp_like(F.trim(x), F.lit(r"^R\$?\s*\d{1,3}(\.\d{3})*(,\d{2})?$|^\d{1,3}(,\d{3})*(\.\d{2})?$|^\d+(\.\d{2})?$"))


def split_descriptions(x: Column) -> Column:
    """Items of a pasted list: by lines, semicolons, and commas that no digit follows."""
    parts = F.filter(F.transform(F.split(x, r"\r?\n|;\s*|,\s*(?!\d)"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(x)))


def semantic_text(title: Column, **parts: Column) -> Column:
    """title | label: value | ..., without the parts that are null or blank; arrays are joined by comma."""
    labelled = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()]
    return F.concat_ws(" | ", title, *labelled)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def user_id(header: Column, cookie: Column, ip: Column, agent: Column) -> Column:
    return F.coalesce(F.nullif(header, F.lit("")), F.nullif(cookie, F.lit("")), F.md5(F.concat_ws(":", F.coalesce(ip, F.lit("")), F.coalesce(agent, F.lit("")))))


def corpus_hash(rows: Column, documents: Column) -> Column:
    """A stamp of a corpus from its sizes; the same for the same input."""
    return F.sha2(F.concat_ws("_", rows.cast("string"), documents.cast("string")), 256)


def is_valid(x: Column, numeric: bool = False) -> Column:
    """Neither null, nor blank, nor not a number."""
    if numeric:
        return x.isNotNull() & ~F.isnan(x)
    return x.isNotNull() & (F.trim(x) != "")


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of a list of tokens, made inside the row by sorting it; null tokens don't count."""

    def runs(ordered: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0))), new)
        tf = lambda s: F.transform(s, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(ordered)) - i).alias("tf")))
        return F.transform(F.array(starts), tf)[0]

    listed = F.transform(F.array(F.sort_array(tokens)), runs)[0]
    return F.filter(listed, lambda x: x["term"].isNotNull())
