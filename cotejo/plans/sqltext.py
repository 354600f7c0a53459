"""DuckDB fragments with the meaning of the text functions, for the oracles."""

from __future__ import annotations

from cotejo.functions.text import ABBREVIATIONS, DOMAIN_SYNONYMS, UNITS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]::VARCHAR[]"


def mapped(entries: dict) -> str:
    return f"map({listed(entries.keys())}, {listed(entries.values())})"



def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    return collapse(f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s]', ' ', 'g')")


def sanitized(x: str) -> str:
    return collapse(f"regexp_replace(strip_accents({x}), '[^A-Za-z0-9_\\s]', ' ', 'g')")


def general(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(lower({x})), '[^a-z0-9\\s.\\-]', ' ', 'g'), '\\s+', ' ', 'g')"


def words(x: str, by: str = " ") -> str:
    return f"list_filter(string_split_regex({x}, {quoted(by)}), lambda w: w <> '')"


def simple_tokens(x: str) -> str:
    return words(f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9]', ' ', 'g')", "\\s+")


def bm25_tokens(x: str) -> str:
    return words(f"lower({x})", "\\s+")


def singular(w: str) -> str:
    return f"CASE WHEN length({w}) <= 3 THEN {w} WHEN {w} LIKE '%es' AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"


def equipment(x: str, abbreviations: dict = ABBREVIATIONS, synonyms: dict = DOMAIN_SYNONYMS) -> str:
    clean = f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s]', ' ', 'g')"
    joined = f"regexp_replace(regexp_replace({clean}, '(\\d+[.,]?\\d*)\\s*(kva|kw|hp|cv|v|hz)\\b', '\\1\\2', 'g'), '(\\d)cv\\b', '\\1hp', 'g')"
    plain = {k: " ".join("".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in v.lower()).split()) for k, v in {**UNITS, **synonyms, **abbreviations}.items()}
    short = mapped(abbreviations)
    every = mapped(plain)
    base = f"CASE WHEN ({short})[w] IS NOT NULL THEN w ELSE {singular('w')} END"
    return f"array_to_string(list_transform(list_transform({words(collapse(joined))}, lambda w: {base}), lambda b: coalesce(({every})[b], b)), ' ')"


def model_numbers(x: str) -> str:
    return f"list_filter(list_transform({words(key(x))}, lambda w: regexp_extract(w, '\\d{{3,}}')), lambda w: w <> '')"


def distinct(x: str) -> str:
    """Distinct items in order of first appearance."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def number(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE)"


def grams(tokens: str, n: int, sep: str = " ") -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(({tokens})[i:i + {n - 1}], {quoted(sep)}))"


def char_grams(x: str, low: int = 3, high: int = 5) -> str:
    parts = ", ".join(f"list_transform(range(1, length(p) - {n} + 2), lambda i: substr(p, i, {n}))" for n in range(low, high + 1))
    return f"flatten(list_transform({words(collapse(f'lower({x})'))}, lambda w: flatten(list_transform([' ' || w || ' '], lambda p: flatten([{parts}])))))"
