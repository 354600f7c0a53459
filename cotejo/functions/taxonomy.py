"""Categories, accessories and the intent of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import let, literal_map, model_numbers, model_numbers_of, normalize_key, words

# Accessory terms, words without meaning, categories and their patterns.
ACCESSORIES = ["disco", "discos", "escova", "escovas", "refil", "refis", "bocal", "saco", "filtro", "mangueira", "pano", "flanela", "esponja", "cabo", "adaptador", "kit", "suporte", "pinca", "pinça"]
STOPWORDS = ["de", "da", "do", "das", "dos", "para", "pra", "com", "sem", "e", "a", "o", "as", "os", "em", "no", "na", "nos", "nas"]
CONNECTORS = ["c", "com", "e", "para", "de", "da", "do", "das", "dos", "a", "o"]
CATEGORY_PATTERNS = {"VASSOURA": r"\b(vassoura|vassourao|piacava|piassava)\b", "MOP": r"\b(mop|esfregao)\b"}
CATEGORY_TOKENS = {"MOP": "mop", "VASSOURA": "vassoura"}
RERANK_CATEGORIES = ["enceradeira", "lavadora", "aspirador", "extratora", "varredeira", "polidora", "vassoura", "mop", "carrinho"]
SINGULARS = {"discos": "disco", "escovas": "escova", "refis": "refil"}
MEASURE = "mm|cm|m|l|lt|litros|v|volts|w|watts|kg|g|hp|rpm"
NUMBER = r"^\d+(?:[.,]\d+)?$"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _folded(terms: list[str]) -> list[str]:
    """Terms as they stand in normalised text, each once and in order."""
    return list(dict.fromkeys(t.replace("ç", "c") for t in terms))


def detect_category(x: Column, patterns: dict = CATEGORY_PATTERNS) -> Column:
    return let(normalize_key(x), lambda norm: _category_of(norm, patterns))


def _category_of(norm: Column, patterns: dict) -> Column:
    out = F.lit("UNKNOWN")
    for name, pattern in reversed(patterns.items()):
        out = F.when(F.regexp_like(norm, F.lit(pattern)), name).otherwise(out)
    return out


def accessories_in(x: Column, terms: list[str] = ACCESSORIES, canonical: bool = True) -> Column:
    """Accessory terms that the text contains anywhere, in the list's order."""
    return let(normalize_key(x), lambda norm: _accessories_of(norm, terms, canonical))


def _accessories_of(norm: Column, terms: list[str], canonical: bool) -> Column:
    found = F.filter(_strings(_folded(terms)), lambda t: norm.contains(t))
    return F.array_distinct(F.transform(found, lambda t: F.coalesce(literal_map(SINGULARS)[t], t))) if canonical else found


def detect_doc_type(x: Column, terms: list[str] = ACCESSORIES, patterns: dict = CATEGORY_PATTERNS) -> Column:
    """Any accessory term makes an ACESSORIO, else a category an EQUIPAMENTO."""
    return F.when(F.size(accessories_in(x, terms)) > 0, "ACESSORIO").when(detect_category(x, patterns) != "UNKNOWN", "EQUIPAMENTO").otherwise("INDEFINIDO")


def _first(tokens: Column, test) -> Column:
    """Place from 0 of the first token that passes; -1 if none does."""
    return (F.array_position(F.transform(tokens, test), True) - 1).cast("int")


def taxonomy_intent(x: Column, terms: list[str] = ACCESSORIES, patterns: dict = CATEGORY_PATTERNS, category_tokens: dict = CATEGORY_TOKENS) -> Column:
    """EQUIPAMENTO if the category's word comes before the first accessory, ACESSORIO if after."""
    both = lambda norm: F.struct(words(norm, " ").alias("tokens"), _category_of(norm, patterns).alias("category"))
    return let(let(normalize_key(x), both), lambda b: _intent_of(b["tokens"], b["category"], terms, category_tokens))


def _intent_of(tokens: Column, category: Column, terms: list[str], category_tokens: dict) -> Column:
    accessory = _first(tokens, lambda t: t.isin(terms))
    place = F.coalesce((F.array_position(tokens, literal_map(category_tokens)[category]) - 1).cast("int"), F.lit(-1))
    before = F.when((place != -1) & (place <= accessory), "EQUIPAMENTO").otherwise("ACESSORIO")
    known = category != "UNKNOWN"
    return F.when(known & (accessory != -1), before).when(known, "EQUIPAMENTO").when(accessory != -1, "ACESSORIO").otherwise("INDEFINIDO")


def measure_terms(x: Column) -> Column:
    """Tokens that name a model or a measure, and "measure" if a number stands before a unit."""
    return let(normalize_key(x), lambda norm: let(words(norm, " "), lambda tokens: _measures_of(norm, tokens)))


def _measures_of(norm: Column, tokens: Column) -> Column:
    unit = lambda t: F.regexp_like(t, F.lit(rf"^\d+(?:[.,]\d+)?(?:{MEASURE})$|^\d{{2,}}[a-z]+$|^[a-z]+\d{{2,}}$"))
    model = lambda t: F.regexp_like(t, F.lit(r"^\d{3,}$"))
    spaced = F.when(F.regexp_like(norm, F.lit(rf"\b\d+(?:[.,]\d+)?\s*({MEASURE})\b")), _strings(["measure"])).otherwise(_strings([]))
    return F.array_distinct(F.concat(F.filter(tokens, unit), F.filter(tokens, model), spaced))


def navigation_context(x: Column, terms: list[str] = ACCESSORIES, patterns: dict = CATEGORY_PATTERNS, category_tokens: dict = CATEGORY_TOKENS, stopwords: list[str] = STOPWORDS) -> Column:
    """struct<tokens, numbers, attributes, accessories, category, measures>; category is null if unknown."""

    def known(norm: Column, tokens: Column) -> Column:
        category = F.nullif(_category_of(norm, patterns), F.lit("UNKNOWN"))
        own = F.coalesce(literal_map(category_tokens)[F.coalesce(category, F.lit(""))], F.lit(""))
        return F.struct(norm.alias("norm"), tokens.alias("tokens"), category.alias("category"), own.alias("own"), _measures_of(norm, tokens).alias("measures"))

    def context(k: Column) -> Column:
        rest = lambda t: ~t.isin([*stopwords, *terms]) & (t != k["own"]) & ~F.regexp_like(t, F.lit(NUMBER)) & ~F.array_contains(k["measures"], t)
        return F.struct(
            k["tokens"].alias("tokens"),
            F.filter(k["tokens"], lambda t: F.regexp_like(t, F.lit(NUMBER))).alias("numbers"),
            F.filter(k["tokens"], rest).alias("attributes"),
            _accessories_of(k["norm"], terms, canonical=False).alias("accessories"),
            k["category"].alias("category"),
            k["measures"].alias("measures"),
        )

    return let(let(normalize_key(x), lambda norm: let(words(norm, " "), lambda tokens: known(norm, tokens))), context)


def is_navigation(context: Column) -> Column:
    """A category and at most one word more, without numbers, attributes, accessories or measures."""
    empty = lambda c, name: F.size(c[name]) == 0
    return let(context, lambda c: c["category"].isNotNull() & (F.size(c["tokens"]) <= 2) & empty(c, "numbers") & empty(c, "attributes") & empty(c, "accessories") & empty(c, "measures"))


def parse_query(x: Column, terms: list[str] = ACCESSORIES, categories: list[str] = RERANK_CATEGORIES) -> Column:
    """struct<intent, main_category, model_numbers, accessory_terms, tokens>.

    The first category word before or at the first accessory word (with or without a final s) means
    equipment, after it an accessory.
    """
    key = let(normalize_key(x), lambda norm: F.struct(norm.alias("norm"), words(norm, " ").alias("tokens")))
    return let(key, lambda k: _parsed_of(k["norm"], k["tokens"], terms, categories))


def _parsed_of(norm: Column, tokens: Column, terms: list[str], categories: list[str]) -> Column:
    either = sorted({*terms, *[t[:-1] for t in terms if t.endswith("s")], *[f"{t}s" for t in terms]})
    places = F.struct(_first(tokens, lambda t: t.isin(categories)).alias("place"), _first(tokens, lambda t: t.isin(either)).alias("accessory"))
    return let(places, lambda p: _parsed_at(norm, tokens, p["place"], p["accessory"], terms))


def _parsed_at(norm: Column, tokens: Column, place: Column, accessory: Column, terms: list[str]) -> Column:
    before = F.when(place <= accessory, "EQUIPAMENTO").otherwise("ACESSORIO")
    intent = F.when((place != -1) & (accessory != -1), before).when(place != -1, "EQUIPAMENTO").when(accessory != -1, "ACESSORIO").otherwise("INDEFINIDO")
    category = F.when(place != -1, F.try_element_at(tokens, F.greatest(place, F.lit(0)) + 1))
    return F.struct(intent.alias("intent"), category.alias("main_category"), model_numbers_of(tokens).alias("model_numbers"), _accessories_of(norm, terms, True).alias("accessory_terms"), tokens.alias("tokens"))


def classify_doc(text: Column, query_numbers: Column, doc_category: Column | None = None, doc_type: Column | None = None, terms: list[str] = ACCESSORIES, categories: list[str] = RERANK_CATEGORIES) -> Column:
    """struct<doc_type, category, has_accessory, has_category, has_model>; what a row carries itself takes precedence."""

    def known(norm: Column, tokens: Column) -> Column:
        found = _first(tokens, lambda t: t.isin(categories)).alias("place")
        return F.struct(tokens.alias("tokens"), found, F.exists(_strings(terms), lambda t: norm.contains(t)).alias("accessory"))

    key = let(normalize_key(text), lambda norm: let(words(norm, " "), lambda tokens: known(norm, tokens)))
    return let(key, lambda k: _classed_of(k["tokens"], k["place"], k["accessory"], query_numbers, doc_category, doc_type))


def _classed_of(tokens: Column, place: Column, accessory: Column, query_numbers: Column, doc_category: Column | None, doc_type: Column | None) -> Column:
    category = F.when(place != -1, F.try_element_at(tokens, F.greatest(place, F.lit(0)) + 1))
    guess = F.when(accessory, "ACESSORIO").when(place != -1, "EQUIPAMENTO").otherwise("INDEFINIDO")
    overlap = F.coalesce(F.arrays_overlap(model_numbers_of(tokens), query_numbers), F.lit(False))
    return F.struct(
        (guess if doc_type is None else F.coalesce(doc_type, guess)).alias("doc_type"),
        (category if doc_category is None else F.coalesce(doc_category, category)).alias("category"),
        accessory.alias("has_accessory"),
        (place != -1).alias("has_category"),
        overlap.alias("has_model"),
    )


def core_query(x: Column, parsed: Column) -> Column:
    """The query without its accessory terms and connectors, if it names any; never empty."""
    return let(parsed, lambda p: _core_of(x, p))


def _core_of(x: Column, parsed: Column) -> Column:
    kept = F.filter(parsed["tokens"], lambda t: ~F.array_contains(parsed["accessory_terms"], t) & ~t.isin(CONNECTORS))
    fallback = F.concat_ws(" ", parsed["main_category"], F.array_join(parsed["model_numbers"], " "))
    found = F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.nullif(F.trim(fallback), F.lit("")), x)
    return F.when(F.size(parsed["accessory_terms"]) == 0, x).otherwise(found)


def specificity(x: Column) -> Column:
    """0.3 to 1: more with model numbers, several terms and technical measures."""
    terms = F.size(words(F.trim(x)))
    technical = F.regexp_like(x, F.lit(r"(?i)\d{2,}\s*(mm|cm|w|v|kg|l|hp|rpm)"))
    total = F.lit(0.3) + F.when(F.size(model_numbers(x)) > 0, 0.4).otherwise(0.0) + F.when(terms >= 2, 0.2).otherwise(0.0) + F.when(technical, 0.1).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.80, "alta").when(score >= 0.60, "media").otherwise("baixa")


def confidence_band(percent: Column) -> Column:
    """Of a confidence in percent; zero counts as missing."""
    return F.when(percent.isNull() | (percent == 0), "N/A").when(percent >= 80, "Excelente").when(percent >= 75, "Muito Boa").when(percent >= 50, "Boa").otherwise("Ruim")


def maintenance_band(percent: Column) -> Column:
    return F.when(percent.isNull(), "N/A").when(percent == 0, "Nenhuma").when(percent <= 20, "Baixa").when(percent <= 50, "Média").otherwise("Alta")


def sample_quality(n: Column, low: Column, high: Column, mean: Column) -> Column:
    """low_sample below three values, high_variation if the range is over half the mean, ok otherwise."""
    return F.when(n < 3, "low_sample").when(F.try_divide(high - low, mean) > 0.5, "high_variation").otherwise("ok")
