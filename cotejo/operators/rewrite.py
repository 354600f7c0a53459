"""Correcting, rewriting and expanding queries, and compiling abbreviations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import text as t
from cotejo.functions.taxonomy import detect_category
from cotejo.operators.index import small

# Limits of fuzzy matching, of rewriting and of compiled lists.
MAX_DISTANCE, MIN_SIMILARITY, MIN_LENGTH = 2, 0.75, 4
VARIANTS, EXPANDED, EXPAND_WEIGHT, LIST_ITEMS = 10, 8, 0.6, 12
TOKEN_KEY = r"^[a-z0-9]{2,6}$"

# Words that mean about the same.
SYNONYMS = {
    "mop": ["mop", "esfregão", "rodo úmido", "vassoura úmida", "esfregona"],
    "esfregao": ["esfregão", "mop", "rodo úmido"],
    "rodo": ["rodo", "rodo seco", "rodo úmido", "mop"],
    "lavadora": ["lavadora", "máquina lavar", "lava piso", "lava chão", "lavadora piso"],
    "maquina lavar": ["máquina lavar", "lavadora", "lava piso"],
    "enceradeira": ["enceradeira", "politriz", "polidora"],
    "aspirador": ["aspirador", "aspirador de pó", "vácuo", "vacuum", "aspira pó"],
    "vacuum": ["vacuum", "aspirador", "vácuo"],
    "soprador": ["soprador", "sopradora", "blower"],
    "lavadora pressao": ["lavadora pressão", "hidro lavadora", "jato pressão", "lavadora alta pressão"],
    "hidrolavadora": ["hidro lavadora", "lavadora pressão", "jato pressão"],
    "balde": ["balde", "bacia", "recipiente", "cuba"],
    "bacia": ["bacia", "balde", "recipiente"],
    "cesto": ["cesto", "lixeira", "cesta"],
    "lixeira": ["lixeira", "cesto lixo", "recipiente lixo"],
    "litro": ["litro", "l", "litros"],
    "galao": ["galão", "gal", "galões"],
    "watts": ["watts", "w", "watt"],
    "volts": ["volts", "v", "volt", "voltagem"],
    "bivolt": ["bivolt", "110 220", "110v 220v"],
    "piassava": ["piaçava", "piassava", "palha"],
    "nylon": ["nylon", "náilon", "nailon"],
    "plastico": ["plástico", "plástica", "plastic"],
    "inox": ["inox", "aço inox", "aço inoxidável"],
    "industrial": ["industrial", "profissional", "comercial"],
    "profissional": ["profissional", "industrial", "comercial"],
    "domestico": ["doméstico", "residencial", "casa"],
    "hospitalar": ["hospitalar", "hospital", "médico"],
}


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def is_fuzzy_match(a: Column, b: Column) -> Column:
    """Short words must be equal; others within two edits and three quarters alike."""
    close = (F.levenshtein(a, b) <= MAX_DISTANCE) & (similarity(a, b) >= MIN_SIMILARITY)
    return F.when((F.length(a) < MIN_LENGTH) | (F.length(b) < MIN_LENGTH), a == b).otherwise(close)


def correct_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, corrected) for distinct tokens against ``vocabulary`` (term, ord).

    A token of the vocabulary, a short one and one without a match stay. The best match is the most
    similar, then the first. Words meet only if they share a piece: within two edits, one of three
    pieces of the longer word stands unchanged in the shorter, moved by two places at most, so the
    join is an equi-join on (piece, place, lengths) and not a pair of everything.
    """
    distinct = tokens.select("token").distinct()
    unknown = distinct.join(vocabulary.select(F.col("term").alias("token")), "token", "left_anti").where(F.length("token") >= MIN_LENGTH)
    found = unknown.select("token", F.explode(_pieces(F.col("token"), moved=True)).alias("piece"))
    words = vocabulary.where(F.length("term") >= 2).select("term", "ord", F.explode(_pieces(F.col("term"), moved=False)).alias("piece"))
    pairs = words.join(small(found), "piece").select("token", "term", "ord").distinct()
    distance = F.levenshtein("token", "term", MAX_DISTANCE)
    alike = pairs.withColumn("d", distance).where("d >= 0").withColumn("s", 1.0 - F.col("d") / F.greatest(F.length("token"), F.length("term"))).where(F.col("s") >= MIN_SIMILARITY)
    best = alike.groupBy("token").agg(F.min_by("term", F.struct((-F.col("s")).alias("s"), "ord")).alias("best"))
    return distinct.join(best, "token", "left").select("token", F.coalesce("best", "token").alias("corrected"))


def _pieces(word: Column, moved: bool) -> Column:
    """Keys of thirds of a vocabulary word by its length and place; for a token, of all it could share.

    A vocabulary word of n letters is cut in three. A token within two edits has a length from
    n - 2 to n + 2 and holds one third unchanged, at most two places away.
    """
    size = F.length(word)
    third = lambda n: F.ceil(n / 3).cast("int")
    if not moved:
        cuts = F.array(*[F.struct(F.lit(k).alias("k"), (third(size) * k + 1).alias("at")) for k in range(3)])
        return F.transform(cuts, lambda c: F.concat_ws(":", size.cast("string"), c["k"].cast("string"), F.substring(word, c["at"], third(size))))
    keys = []
    for change in range(-MAX_DISTANCE, MAX_DISTANCE + 1):
        n = size + change
        for k in range(3):
            for move in range(-MAX_DISTANCE, MAX_DISTANCE + 1):
                at = third(n) * k + 1 + move
                keys.append(F.when((n >= 2) & (at >= 1), F.concat_ws(":", n.cast("string"), F.lit(str(k)), F.substring(word, at, F.least(third(n), n - third(n) * k)))))
    return F.array_distinct(F.filter(F.array(*keys), lambda x: x.isNotNull()))


def correct_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds corrected to (query_id, query): each token replaced by its correction."""
    tokens = queries.select("query_id", F.posexplode_outer(t.words(F.lower("query"))).alias("pos", "token"))
    fixed = correct_tokens(tokens.where("token is not null"), vocabulary)
    joined = tokens.join(fixed, "token", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "corrected"))).alias("c"))
    done = joined.select("query_id", F.array_join(F.transform("c", lambda x: x["corrected"]), " ").alias("corrected"))
    return queries.join(done, "query_id")


def synonyms_of(term: Column, table: dict[str, list[str]] = SYNONYMS) -> Column:
    """The list of a term, else of the first entry that has it in its list, else the term alone."""
    direct = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    reverse: dict[str, str] = {}
    for key, listed in table.items():
        for word in listed:
            reverse.setdefault(word, key)
    low = F.trim(F.lower(term))
    return F.coalesce(direct[low], direct[t.literal_map(reverse)[low]], F.array(low))


def expand_synonyms(x: Column, most: int = 5, table: dict[str, list[str]] = SYNONYMS) -> Column:
    """The query, and it with one token at a time replaced by a synonym; at most so many, in order."""
    tokens = F.split(F.lower(x), r"\s+")

    def replaced(token: Column, i: Column) -> Column:
        others = F.filter(synonyms_of(token, table), lambda s: s != token)
        changed = F.transform(others, lambda s: F.array_join(F.transform(tokens, lambda u, j: F.when(j == i, s).otherwise(u)), " "))
        return F.when(token == "", F.array().cast("array<string>")).otherwise(changed)

    return F.slice(F.array_distinct(F.concat(F.array(F.lower(x)), F.flatten(F.transform(tokens, replaced)))), 1, most)


@dataclass
class Abbreviations:
    """Compiled maps: whole queries, single tokens, and lists that a word expands to."""

    exact: dict[str, str] = field(default_factory=dict)
    token: dict[str, str] = field(default_factory=dict)
    expand: dict[str, list[str]] = field(default_factory=dict)


def rewrite_plan(queries: DataFrame, maps: Abbreviations) -> DataFrame:
    """(query_id, ord, query, weight, reason): the primary query first, then its distinct variants."""
    exact, token = t.literal_map(maps.exact or {"": ""}), t.literal_map(maps.token or {"": ""})
    expand = F.create_map(*[x for k, v in (maps.expand or {"": [""]}).items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v[:EXPANDED]]))])
    none = F.array().cast("array<struct<query:string,weight:double,reason:string>>")

    def variant(query: Column, weight: Column, reason: str) -> Column:
        return F.array(F.struct(query.alias("query"), weight.cast("double").alias("weight"), F.lit(reason).alias("reason")))

    one_category = lambda q: (F.size(t.words(q, " ")) == 1) & (detect_category(q) != "UNKNOWN")

    def step(df: DataFrame, rewritten: Column, reason: str) -> DataFrame:
        df = df.withColumn("new", t.normalize_key(rewritten)).withColumn("keeps", one_category(F.col("primary")))
        hit = F.coalesce((F.col("new") != "") & (F.col("new") != F.col("primary")), F.lit(False))
        weight = F.when(F.col("keeps"), F.lit(EXPAND_WEIGHT)).otherwise(1.0)
        df = df.withColumn("variants", F.when(hit, F.concat("variants", variant(F.col("new"), weight, reason))).otherwise(F.col("variants")))
        return df.withColumn("primary", F.when(hit & ~F.col("keeps"), F.col("new")).otherwise(F.col("primary"))).drop("new", "keeps")

    plan = queries.select("query_id", t.normalize_key(F.col("query")).alias("primary"), none.alias("variants"))
    plan = step(plan, exact[F.col("primary")], "exactMap")
    plan = step(plan, F.array_join(F.transform(t.words(F.col("primary"), " "), lambda w: F.coalesce(token[w], w)), " "), "tokenMap")
    generic = (F.size(t.words(F.col("primary"), " ")) == 1) & (F.length("primary") >= 2) & ~F.regexp_like("primary", F.lit(r"\d"))
    items = F.filter(F.transform(expand[F.col("primary")], t.normalize_key), lambda q: (q != "") & (q != F.col("primary")))
    more = F.transform(items, lambda q: F.struct(q.alias("query"), F.lit(EXPAND_WEIGHT).alias("weight"), F.lit("expandMap").alias("reason")))
    every = F.concat(variant(F.col("primary"), F.lit(1.0), "primary"), "variants", F.when(generic, F.coalesce(more, none)).otherwise(none))
    rows = plan.select("query_id", F.posexplode(every).alias("pos", "v")).select("query_id", "pos", "v.*")
    first = rows.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("pos"))).where("again = 1")
    placed = first.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("ord") <= VARIANTS)
    return placed.select("query_id", "ord", "query", "weight", "reason")


def entity_list(value: Column) -> Column:
    """The distinct normalised items of a comma list of entities; null if it isn't one (prices, decimals, numbers)."""
    items = F.array_distinct(F.filter(F.transform(F.split(value, ","), t.normalize_key), lambda x: x != ""))
    listed = F.regexp_like(value, F.lit(r",\s+\p{L}")) & ~F.regexp_like(value, F.lit(r"\d,\d")) & ~F.regexp_like(value, F.lit(r"(?i)\bR\$\b"))
    lettered = F.size(F.filter(items, lambda x: F.regexp_like(x, F.lit("[a-z]")))) >= 2
    return F.when(listed & (F.size(items) >= 2) & lettered, items)


def plural(x: Column) -> Column:
    """A naive plural, by which lists are keyed."""
    return F.when(x.endswith("s"), x).otherwise(F.concat(x, F.lit("s")))


def observe_abbreviations(pairs: DataFrame) -> DataFrame:
    """(ord, key, value, kind, items, signature) of each variant of ``pairs`` (ord, key, value); keys are cut at |."""
    rows = pairs.select("ord", F.explode(F.split("key", r"\|")).alias("raw"), F.coalesce("value", F.lit("")).alias("value"))
    rows = rows.select("ord", t.normalize_key(F.col("raw")).alias("norm"), "value", t.normalize_key(F.col("value")).alias("norm_value")).where("norm <> '' and norm_value <> ''")
    rows = rows.withColumn("items", entity_list(F.col("value")))
    kind = F.when(F.col("items").isNotNull(), "expand").when(F.regexp_like("norm", F.lit(TOKEN_KEY)), "token").otherwise("exact")
    rows = rows.withColumn("kind", kind).withColumn("key", F.when(F.col("kind") == "expand", plural(F.col("norm"))).otherwise(F.col("norm")))
    signature = F.when(F.col("kind") == "expand", F.concat(F.lit("LIST:"), F.array_join("items", "|"))).otherwise(F.concat(F.lit("SINGLE:"), F.col("norm_value")))
    return rows.select("ord", "key", F.col("norm_value").alias("value"), "kind", "items", signature.alias("signature"))


def compile_abbreviations(pairs: DataFrame) -> DataFrame:
    """(key, kind, value): unambiguous entries. Lists are joined by | ; of equal keys the last value wins.

    A key that stands for different things, or is of different kinds, is left out.
    """
    seen = observe_abbreviations(pairs)
    clear = seen.groupBy("key").agg(F.count_distinct("signature").alias("s"), F.count_distinct("kind").alias("k")).where("s = 1 and k = 1").select("key")
    kept = seen.join(clear, "key").groupBy("key", "kind").agg(F.max_by("value", "ord").alias("value"), F.max_by("items", "ord").alias("items"))
    useful = (F.col("kind") == "expand") | ((F.col("value") != F.col("key")) & ((F.col("kind") == "token") | (F.length("value") >= 4)))
    return kept.where(useful).select("key", "kind", F.when(F.col("kind") == "expand", F.array_join(F.slice("items", 1, LIST_ITEMS), "|")).otherwise(F.col("value")).alias("value"))


def token_usage(pairs: DataFrame, most: int = 20) -> DataFrame:
    """The most used token keys: (token, n)."""
    used = observe_abbreviations(pairs).where("kind = 'token'").groupBy(F.col("key").alias("token")).agg(F.count("*").alias("n"))
    return used.orderBy(F.desc("n"), "token").limit(most)
