"""Queries of the text, attribute, domain and taxonomy functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import attributes, domain, taxonomy, text
from cotejo.plans import sqltext as s
from cotejo.session import spread
from cotejo.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# Query and product texts that the word lists know.
PHRASES = [
    "Vassoura", "Mop úmido", "enceradeira 510", "Enceradeira de piso 510 c/ discos e escovas", "disco para enceradeira", "lavadora de alta pressão 220v 2000 psi", "aspirador de pó e água 60 litros 1400w bivolt",
    "balde espremedor 30l", "motor trifásico 7 hp", "notebook 14 pol", "carrinho funcional", "vassoura nylon 60 cm", "refil mop 320g", "mangueira 10 m", "", "vassouras", "asp 1,5 hp", "hidrojat 500 bar", "esfregão", "rodo 60cm", "cabo mop", "extratora 12 gal 1750 rpm bateria", "pano de chão", "politriz 20 in",
]
PHRASE_SQL = "(VALUES " + ", ".join(f"({k}, {s.quoted(p)})" for k, p in enumerate(PHRASES)) + ") AS p(query_id, query)"


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PHRASES)), "query_id int, query string")


#: The phrases, and each part's name behind one of them, in turn.
MIXED_SQL = f"(SELECT * FROM {PHRASE_SQL} UNION ALL SELECT p_partkey + 1000, ({s.listed(PHRASES)})[p_partkey % {len(PHRASES)} + 1] || ' ' || p_name FROM part) AS p(query_id, query)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("p_partkey") % len(PHRASES) + 1).cast("int")
    named = F.concat(F.element_at(F.array(*[F.lit(p) for p in PHRASES]), place), F.lit(" "), F.col("p_name"))
    parts = spread(table(spark, sf_dir, "part")).select((F.col("p_partkey") + 1000).alias("query_id"), named.alias("query"))
    return phrases(spark).withColumn("query_id", F.col("query_id").cast("long")).unionByName(parts)


def joined(x: Column) -> Column:
    return F.array_join(x, "|")


def bar(x: str) -> str:
    return f"array_to_string({x}, '|')"


def _over(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], base: Callable[[], Column] | None = None) -> None:
    """Registers one query over a table: its key and the columns, with the SQL of each; ``base`` is what several columns read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = mixed(spark, sf_dir) if source == "phrases" else spread(table(spark, sf_dir, source))
        if base is not None:
            rows = rows.select(key, base().alias("base"))
        return rows.select(key, *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = run
    shown = ", ".join(f"{q} AS {n}" for n, q in sql.items())
    ORACLE_SQL[name] = f"SELECT {key}, {shown} FROM {MIXED_SQL if source == 'phrases' else source}"


_over("normalize_text", "documents", "doc_id", lambda: {
    "norm": text.normalize_key(F.col("text")),
}, {
    "norm": s.key("text"),
})
_over("sanitize_text", "documents", "doc_id", lambda: {
    "clean": text.sanitize(F.col("text")),
}, {
    "clean": s.sanitized("text"),
})
_over("strip_accents", "documents", "doc_id", lambda: {
    "folded": text.strip_accents(F.col("text")),
}, {
    "folded": "strip_accents(text)",
})
_over("normalize_general", "documents", "doc_id", lambda: {
    "norm": text.normalize_general(F.col("text")),
}, {
    "norm": s.general("text"),
})
_over("preprocess", "documents", "doc_id", lambda: {
    "clean": text.preprocess(F.col("text")),
}, {
    "clean": s.collapse("lower(text)"),
})
_over("consonant_key", "documents", "doc_id", lambda: {
    "key": text.consonant_key(F.col("text")),
}, {
    "key": f"substr(regexp_replace({s.key('text')}, '[aeiou\\s]', '', 'g'), 1, 10)",
})
_over("simple_tokenize", "documents", "doc_id", lambda: {
    "tokens": joined(text.simple_tokens(F.col("text"))),
}, {
    "tokens": bar(s.simple_tokens("text")),
})
_over("bm25_tokenize", "documents", "doc_id", lambda: {
    "tokens": joined(text.bm25_tokens(F.col("text"))),
}, {
    "tokens": bar(s.bm25_tokens("text")),
})
_over("alphanumeric_split", "documents", "doc_id", lambda: {
    "apart": text.split_alphanumeric(F.col("text")),
}, {
    "apart": s.collapse("lower(regexp_replace(regexp_replace(text, '([0-9]+)([a-zA-Z]+)', '\\1 \\2', 'g'), '([a-zA-Z]+)([0-9]+)', '\\1 \\2', 'g'))"),
})
_over("numeric_tokens", "documents", "doc_id", lambda: {
    "models": joined(text.model_numbers(F.col("text"))),
    "n_distinct": F.size(text.numeric_tokens(F.col("text"))).cast("long"),
    "overlap": F.coalesce(F.arrays_overlap(text.model_numbers(F.col("text")), F.array(F.lit("152"), F.lit("510"))), F.lit(False)),
}, {
    "models": bar(s.model_numbers("text")),
    "n_distinct": f"len(list_distinct({s.model_numbers('text')}))::BIGINT",
    "overlap": f"list_has_any({s.model_numbers('text')}, ['152', '510'])",
})
_over("normalize_equipment", "phrases", "query_id", lambda: {
    "norm": text.normalize_equipment(F.col("query")),
    "signature": text.consonant_signature(F.col("query")),
    "variants": joined(text.expansion_variants(F.col("query"))),
}, {
    "norm": s.equipment("query"),
    "signature": f"substr(regexp_replace({s.equipment('query')}, '[^b-df-hj-np-tv-z]', '', 'g'), 1, 12) || '_' || regexp_replace({s.equipment('query')}, '\\D', '', 'g')",
    "variants": "CASE WHEN list_contains(string_split(lower(query), ' '), 'vassouras') THEN 'vassoura nylon|vassoura piacava|vassoura feiticeira|vassoura de teto|vassourao' ELSE '' END",
})
_over("normalize_products", "part", "p_partkey", lambda: {
    "norm": text.normalize_equipment(F.concat_ws(" ", F.col("p_name"), F.lit("7 CV 220 volts"))),
}, {
    "norm": s.equipment("p_name || ' ' || '7 CV 220 volts'"),
})
_over("char_ngrams", "part", "p_partkey", lambda: {
    "grams": joined(text.char_ngrams(F.col("p_name"))),
}, {
    "grams": bar(s.char_grams("p_name")),
})
_over("word_ngrams", "part", "p_partkey", lambda: {
    "grams": joined(text.word_ngrams(F.col("p_name"))),
}, {
    "grams": bar(f"flatten([{s.grams(s.simple_tokens('p_name'), 1)}, {s.grams(s.simple_tokens('p_name'), 2)}])"),
})


def _price() -> Column:
    return F.format_string("%.2f", "p_retailprice")


def _br() -> Column:
    return F.translate(F.format_number("p_retailprice", 2), ",.", ".,")


_BR_SQL = "translate(format('{:,.2f}', p_retailprice), ',.', '.,')"
_over("parse_br_number", "part", "p_partkey", lambda: {
    "number": text.parse_br_number(_br()),
    "trailing": text.parse_br_number(F.concat(_br(), F.lit(" un"))),
    "american": text.parse_br_number(_price()),
    "none": text.parse_br_number(F.col("p_name")),
}, {
    "number": s.number(f"replace(replace({_BR_SQL}, '.', ''), ',', '.')"),
    "trailing": s.number(f"replace(replace({_BR_SQL} || ' un', '.', ''), ',', '.')"),
    "american": s.number("replace(printf('%.2f', p_retailprice), '.', '')"),
    "none": "NULL::DOUBLE",
})
_over("parse_brl_currency", "part", "p_partkey", lambda: {
    "price": text.parse_brl(F.concat(F.lit("R$ "), _br())),
    "plain": text.parse_brl(_price()),
    "bad": text.parse_brl(F.when(F.col("p_size") % 2 == 0, "N/A").otherwise("-12,50")),
    "valid": text.is_brl_format(F.concat(F.lit("R$ "), _br())),
    "valid_name": text.is_brl_format(F.col("p_name")),
}, {
    "price": "round(p_retailprice, 2)",
    "plain": "round(p_retailprice, 2)",
    "bad": "0.0::DOUBLE",
    "valid": "true",
    "valid_name": "false",
})
_over("format_brl", "part", "p_partkey", lambda: {
    "price": text.format_brl(F.col("p_retailprice")),
}, {
    "price": f"'R$' || chr(160) || {_BR_SQL}",
})
_over("split_descriptions", "documents", "doc_id", lambda: {
    "items": joined(text.split_descriptions(F.col("text"))),
}, {
    "items": "array_to_string(CASE WHEN len({0}) > 0 THEN {0} ELSE [trim(text)] END, '|')".format("list_filter(list_transform(string_split_regex(regexp_replace(text, ',(\\d)', chr(1) || '\\1', 'g'), '\\r?\\n|;\\s*|,\\s*'), lambda x: trim(replace(x, chr(1), ','))), lambda x: x <> '')"),
})
_over("semantic_text", "supplier", "s_suppkey", lambda: {
    "semantic": text.semantic_text(F.col("s_name"), Marca=F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("s_nationkey"))), Fonte=F.lit("bid")),
    "chosen": text.first_text(F.lit("  "), F.when(F.col("s_nationkey") > 10, F.col("s_name")), F.lit("none")),
}, {
    "semantic": "s_name || CASE WHEN s_nationkey % 2 = 0 THEN ' | Marca: n' || s_nationkey ELSE '' END || ' | Fonte: bid'",
    "chosen": "CASE WHEN s_nationkey > 10 THEN s_name ELSE 'none' END",
})
_over("user_id", "customer", "c_custkey", lambda: {
    "user_id": text.user_id(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.lit(""), F.concat(F.lit("10.0.0."), F.col("c_nationkey")), F.col("c_mktsegment")),
}, {
    "user_id": "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE md5('10.0.0.' || c_nationkey || ':' || c_mktsegment) END",
})


def _text() -> Column:
    return F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.when(F.col("p_size") % 3 == 0, " litros 110 V").when(F.col("p_size") % 3 == 1, ' gal 2000 psi bivolt').otherwise(",5 mm 1750 rpm 12 bar bateria"))


_TEXT_SQL = "p_name || ' ' || p_size || CASE WHEN p_size % 3 = 0 THEN ' litros 110 V' WHEN p_size % 3 = 1 THEN ' gal 2000 psi bivolt' ELSE ',5 mm 1750 rpm 12 bar bateria' END"

def _full() -> Column:
    return attributes.full_attributes(_text())


def _simple() -> Column:
    return attributes.simple_attributes(_text())


def _measure(x: str, unit: str) -> str:
    return f"TRY_CAST(replace(regexp_extract({x}, '(?i)(\\d+[.,]?\\d*)\\s*(?:{unit})\\b', 1), ',', '.') AS DOUBLE)"


_VOLTS = "lower(regexp_extract({x}, '(?i)\\b(110|127|220|230|240|12|24)\\s*v\\b|\\bbivolt\\b'))"
_over("extract_attributes", "part", "p_partkey", lambda: {
    "capacity_l": F.round(_full()["capacity_l"], 6),
    "pressure_bar": F.round(_full()["pressure_bar"], 6),
    "diameter_mm": F.round(_full()["diameter_mm"], 6),
    "voltage_v": _full()["voltage_v"],
    "is_bivolt": _full()["is_bivolt"],
    "rpm": _full()["rpm"],
    "power_source": _full()["power_source"],
}, {
    "capacity_l": f"round(coalesce({_measure(_TEXT_SQL, 'l|litros?|liter|liters?')}, {_measure(_TEXT_SQL, 'gal|gallon|gallons')} * 3.78541), 6)",
    "pressure_bar": f"round(coalesce({_measure(_TEXT_SQL, 'psi')} * 0.0689476, {_measure(_TEXT_SQL, 'bar')}), 6)",
    "diameter_mm": f"round(coalesce({_measure(_TEXT_SQL, 'in|inch|inches')} * 25.4, {_measure(_TEXT_SQL, 'mm')}), 6)",
    "voltage_v": f"TRY_CAST(regexp_extract({_VOLTS.format(x=_TEXT_SQL)}, '^\\d+') AS INTEGER)",
    "is_bivolt": f"{_VOLTS.format(x=_TEXT_SQL)} = 'bivolt'",
    "rpm": _measure(_TEXT_SQL, "rpm"),
    "power_source": "CASE WHEN p_size % 3 = 2 THEN 'battery' END",
})
_over("simple_attributes", "part", "p_partkey", lambda: {
    "voltagem": _simple()["voltagem"],
    "tamanho_m": F.round(_simple()["tamanho_m"], 6),
    "merged_rpm": attributes.merged_attributes(_text())["rpm"],
}, {
    "voltagem": f"nullif(regexp_extract({s.general(_TEXT_SQL)}, '(\\b110\\b|\\b127\\b|\\b220\\b|bivolt)', 1), '')",
    "tamanho_m": "round({0} / CASE {1} WHEN 'mm' THEN 1000 WHEN 'cm' THEN 100 ELSE 1 END, 6)".format(f"TRY_CAST(replace(regexp_extract({s.general(_TEXT_SQL)}, '(\\d+[.,]?\\d*)\\s*(mm|cm|m)', 1), ',', '.') AS DOUBLE)", f"regexp_extract({s.general(_TEXT_SQL)}, '(\\d+[.,]?\\d*)\\s*(mm|cm|m)', 2)"),
    "merged_rpm": _measure(_TEXT_SQL, "rpm"),
})

_POWERED = [" gas", " com tomada", " corded lithium", "", " eletrico 220v"]


def _powered() -> Column:
    return F.concat(F.regexp_replace(_text(), " bateria$", ""), F.element_at(F.array(*map(F.lit, _POWERED)), (F.col("p_partkey") % 5 + 1).cast("int")))


_POWERED_SQL = f"(regexp_replace({_TEXT_SQL}, ' bateria$', '') || ({s.listed(_POWERED)})[p_partkey % 5 + 1])"
_MERGED = ["voltagem", "tamanho_m", "capacity_l", "pressure_bar", "diameter_mm", "voltage_v", "is_bivolt", "rpm", "power_source"]
QUERIES["merged_attributes"] = lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", attributes.merged_attributes(_powered()).alias("a")).select("p_partkey", *[F.round(f"a.{n}", 6).alias(n) if n in ("tamanho_m", "capacity_l", "pressure_bar", "diameter_mm", "rpm") else F.col(f"a.{n}").alias(n) for n in _MERGED])
_KINDS = " ".join(f"WHEN {' OR '.join(f'contains(g, {s.quoted(w)})' for w in terms)} THEN '{name}'" for name, terms in attributes.POWER.items())
ORACLE_SQL["merged_attributes"] = f"""WITH t AS (SELECT p_partkey, x, {s.general('x')} AS g FROM (SELECT p_partkey, {_POWERED_SQL} AS x FROM part))
SELECT p_partkey, nullif(regexp_extract(g, '(\\b110\\b|\\b127\\b|\\b220\\b|bivolt)', 1), '') AS voltagem,
  round(TRY_CAST(replace(regexp_extract(g, '(\\d+[.,]?\\d*)\\s*(mm|cm|m)', 1), ',', '.') AS DOUBLE) / CASE regexp_extract(g, '(\\d+[.,]?\\d*)\\s*(mm|cm|m)', 2) WHEN 'mm' THEN 1000 WHEN 'cm' THEN 100 ELSE 1 END, 6) AS tamanho_m,
  round(coalesce({_measure('x', 'l|litros?|liter|liters?')}, {_measure('x', 'gal|gallon|gallons')} * 3.78541), 6) AS capacity_l,
  round(coalesce({_measure('x', 'psi')} * 0.0689476, {_measure('x', 'bar')}), 6) AS pressure_bar, round(coalesce({_measure('x', 'in|inch|inches')} * 25.4, {_measure('x', 'mm')}), 6) AS diameter_mm,
  TRY_CAST(regexp_extract({_VOLTS.format(x='x')}, '^\\d+') AS INTEGER) AS voltage_v, {_VOLTS.format(x='x')} = 'bivolt' AS is_bivolt, round({_measure('x', 'rpm')}, 6) AS rpm, CASE {_KINDS} END AS power_source FROM t"""


def _boost() -> Column:
    return attributes.numeric_boost(attributes.full_attributes(F.lit("20 litros 220v 1800 rpm")), attributes.full_attributes(F.concat(F.col("p_size"), F.lit(" litros 220v "), F.col("p_size") * 50, F.lit(" rpm"))))


_RATIO = "CASE WHEN least({a}, {b}) / greatest({a}, {b}) >= {t} THEN least({a}, {b}) / greatest({a}, {b}) ELSE 0 END"
_over("numeric_boost", "part", "p_partkey", lambda: {
    "boost": F.round(_boost(), 6),
}, {
    "boost": "round((" + _RATIO.format(a="p_size::DOUBLE", b="20.0::DOUBLE", t="0.8") + " + " + _RATIO.format(a="(p_size * 50)::DOUBLE", b="1800.0::DOUBLE", t="0.9") + " + 1) / 3, 6)",
})


def _contains(norm: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({norm}, {s.quoted(x)})" for x in terms) + ")"


_CATEGORY = "CASE WHEN e = '' THEN 'unknown' WHEN {0} THEN 'cleaning_support' WHEN {1} THEN 'cleaning_core' WHEN {2} THEN 'peripheral' WHEN contains(e, 'motor') AND {3} THEN 'peripheral' ELSE 'unknown' END".format(
    _contains("e", domain.SUPPORT), _contains("e", domain.CORE), _contains("e", domain.PERIPHERAL), "(" + " OR ".join(f"regexp_matches(e, {s.quoted(m)})" for m in domain.MOTOR) + ")"
)
_CONFIDENCE = "CASE WHEN e = '' THEN 0.1 WHEN {0} THEN 0.9 WHEN {1} THEN 0.95 WHEN {2} THEN 0.9 WHEN contains(e, 'motor') AND {3} THEN 0.85 ELSE 0.3 END".format(
    _contains("e", domain.SUPPORT), _contains("e", domain.CORE), _contains("e", domain.PERIPHERAL), "(" + " OR ".join(f"regexp_matches(e, {s.quoted(m)})" for m in domain.MOTOR) + ")"
)
_CLASSED_SQL = f"(SELECT query_id, query, {_CATEGORY} AS category, ({_CONFIDENCE})::DOUBLE AS confidence FROM (SELECT query_id, query, {s.equipment('query')} AS e FROM {PHRASE_SQL}))"
_MIXED_CLASSED_SQL = _CLASSED_SQL.replace(PHRASE_SQL, MIXED_SQL)
_over("domain_classify", "phrases", "query_id", lambda: {
    "category": domain.classify(F.col("query"))["category"],
    "confidence": domain.classify(F.col("query"))["confidence"],
}, {
    "category": "category",
    "confidence": "confidence",
})
ORACLE_SQL["domain_classify"] = f"SELECT query_id, category, confidence FROM {_MIXED_CLASSED_SQL}"


def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mixed(spark, sf_dir).select("query_id", domain.classify(F.col("query")).alias("q"))
    b = phrases(spark).select(F.col("query_id").alias("doc_id"), domain.classify_document(F.col("query"), F.lit(None).cast("string")).alias("d"))
    return a.crossJoin(F.broadcast(b)).select("query_id", "doc_id", F.round(domain.domain_score(F.col("q"), F.col("d")), 6).alias("score"))


QUERIES["domain_score"] = domain_scores
_MATRIX = "(VALUES " + ", ".join(f"('{q}', '{d}', {v})" for q, row in domain.SUITS.items() for d, v in row.items()) + ") AS m(q, d, base)"
ORACLE_SQL["domain_score"] = f"""SELECT a.query_id, b.query_id AS doc_id, round(m.base * (0.5 + 0.5 * a.confidence * b.confidence), 6)::DOUBLE AS score
FROM {_MIXED_CLASSED_SQL} a CROSS JOIN {_CLASSED_SQL} b JOIN {_MATRIX} ON m.q = a.category AND m.d = b.category"""


def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(spark, sf_dir).select(domain.classify(F.col("query"))["category"].alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


QUERIES["domain_stats"] = domain_stats
ORACLE_SQL["domain_stats"] = f"SELECT category, count(*)::BIGINT AS n FROM {_MIXED_CLASSED_SQL} GROUP BY category"

_DETECTED = f"CASE WHEN regexp_matches({s.key('query')}, '\\b(vassoura|vassourao|piacava|piassava)\\b') THEN 'VASSOURA' WHEN regexp_matches({s.key('query')}, '\\b(mop|esfregao)\\b') THEN 'MOP' ELSE 'UNKNOWN' END"
_TERMS = list(dict.fromkeys(x.replace("ç", "c") for x in taxonomy.ACCESSORIES))
_ANY = _contains(s.key("query"), _TERMS)
_over("doc_category", "phrases", "query_id", lambda: {
    "category": taxonomy.detect_category(F.col("query")),
    "doc_type": taxonomy.detect_doc_type(F.col("query")),
}, {
    "category": _DETECTED,
    "doc_type": f"CASE WHEN {_ANY} THEN 'ACESSORIO' WHEN {_DETECTED} <> 'UNKNOWN' THEN 'EQUIPAMENTO' ELSE 'INDEFINIDO' END",
})


def _first(tokens: str, terms: list[str]) -> str:
    return f"coalesce(list_position(list_transform({tokens}, lambda w: list_contains({s.listed(terms)}, w)), true), 0)::INTEGER - 1"


_TOKENS = s.words(s.key("query"))
_OWN = f"CASE {_DETECTED} WHEN 'MOP' THEN 'mop' WHEN 'VASSOURA' THEN 'vassoura' END"
_over("taxonomy_intent", "phrases", "query_id", lambda: {
    "intent": taxonomy.taxonomy_intent(F.col("query")),
}, {
    "intent": f"""CASE WHEN {_DETECTED} <> 'UNKNOWN' AND {_first(_TOKENS, taxonomy.ACCESSORIES)} <> -1
  THEN CASE WHEN coalesce(list_position({_TOKENS}, {_OWN}), 0) - 1 BETWEEN 0 AND {_first(_TOKENS, taxonomy.ACCESSORIES)} THEN 'EQUIPAMENTO' ELSE 'ACESSORIO' END
  WHEN {_DETECTED} <> 'UNKNOWN' THEN 'EQUIPAMENTO' WHEN {_first(_TOKENS, taxonomy.ACCESSORIES)} <> -1 THEN 'ACESSORIO' ELSE 'INDEFINIDO' END""",
})

_UNIT = rf"^\d+(?:[.,]\d+)?(?:{taxonomy.MEASURE})$|^\d{{2,}}[a-z]+$|^[a-z]+\d{{2,}}$"
_MEASURES = f"list_concat(list_filter({_TOKENS}, lambda w: regexp_matches(w, {s.quoted(_UNIT)})), list_concat(list_filter({_TOKENS}, lambda w: regexp_matches(w, '^\\d{{3,}}$')), CASE WHEN regexp_matches({s.key('query')}, {s.quoted(rf'\b\d+(?:[.,]\d+)?\s*({taxonomy.MEASURE})\b')}) THEN ['measure'] ELSE []::VARCHAR[] END))"

def _context() -> Column:
    return taxonomy.navigation_context(F.col("query"))


_ATTRIBUTES = f"list_filter({_TOKENS}, lambda w: NOT list_contains({s.listed([*taxonomy.STOPWORDS, *taxonomy.ACCESSORIES])}, w) AND w <> coalesce({_OWN}, '') AND NOT regexp_matches(w, '^\\d+(?:[.,]\\d+)?$') AND NOT list_contains({_MEASURES}, w))"
_FOUND = f"list_filter({s.listed(_TERMS)}, lambda a: contains({s.key('query')}, a))"
_over("navigation_intent", "phrases", "query_id", lambda: {
    "numbers": joined(F.col("base")["numbers"]),
    "attributes": joined(F.col("base")["attributes"]),
    "accessories": joined(F.col("base")["accessories"]),
    "n_measures": F.size(F.col("base")["measures"]).cast("long"),
    "navigation": taxonomy.is_navigation(F.col("base")),
}, {
    "numbers": bar(f"list_filter({_TOKENS}, lambda w: regexp_matches(w, '^\\d+(?:[.,]\\d+)?$'))"),
    "attributes": bar(_ATTRIBUTES),
    "accessories": bar(_FOUND),
    "n_measures": f"len(list_distinct({_MEASURES}))::BIGINT",
    "navigation": f"{_DETECTED} <> 'UNKNOWN' AND len({_TOKENS}) <= 2 AND NOT {_ANY} AND len({_MEASURES}) = 0 AND len({_ATTRIBUTES}) = 0 AND NOT regexp_matches({s.key('query')}, '(^| )\\d+( |$)')",
}, _context)

_EITHER = sorted({*taxonomy.ACCESSORIES, *[x[:-1] for x in taxonomy.ACCESSORIES if x.endswith("s")], *[f"{x}s" for x in taxonomy.ACCESSORIES]})
_CAT, _ACC = _first(_TOKENS, taxonomy.RERANK_CATEGORIES), _first(_TOKENS, _EITHER)
_INTENT = f"CASE WHEN {_CAT} <> -1 AND {_ACC} <> -1 THEN CASE WHEN {_CAT} <= {_ACC} THEN 'EQUIPAMENTO' ELSE 'ACESSORIO' END WHEN {_CAT} <> -1 THEN 'EQUIPAMENTO' WHEN {_ACC} <> -1 THEN 'ACESSORIO' ELSE 'INDEFINIDO' END"
_MAIN = f"CASE WHEN {_CAT} <> -1 THEN ({_TOKENS})[{_CAT} + 1] END"
_SINGULAR = f"list_transform({_FOUND}, lambda a: CASE a WHEN 'discos' THEN 'disco' WHEN 'escovas' THEN 'escova' WHEN 'refis' THEN 'refil' ELSE a END)"
_CANON = s.distinct(_SINGULAR)

def _parsed() -> Column:
    return taxonomy.parse_query(F.col("query"))


_over("parse_query", "phrases", "query_id", lambda: {
    "intent": F.col("base")["intent"],
    "main_category": F.col("base")["main_category"],
    "models": joined(F.col("base")["model_numbers"]),
    "accessories": joined(F.col("base")["accessory_terms"]),
}, {
    "intent": _INTENT,
    "main_category": _MAIN,
    "models": bar(s.model_numbers("query")),
    "accessories": bar(_CANON),
}, _parsed)
_KEPT = f"array_to_string(list_filter({_TOKENS}, lambda w: NOT list_contains({_CANON}, w) AND NOT list_contains({s.listed(taxonomy.CONNECTORS)}, w)), ' ')"
_over("core_query", "phrases", "query_id", lambda: {
    "core": taxonomy.core_query(F.col("query"), _parsed()),
}, {
    "core": f"CASE WHEN len({_FOUND}) = 0 THEN query ELSE coalesce(nullif({_KEPT}, ''), nullif(trim(coalesce({_MAIN}, '') || ' ' || array_to_string({s.model_numbers('query')}, ' ')), ''), query) END",
})

def _doc() -> Column:
    return taxonomy.classify_doc(F.col("query"), F.array(F.lit("510"), F.lit("320")))


_over("classify_doc", "phrases", "query_id", lambda: {
    "doc_type": F.col("base")["doc_type"],
    "category": F.col("base")["category"],
    "has_model": F.col("base")["has_model"],
}, {
    "doc_type": f"CASE WHEN {_contains(s.key('query'), taxonomy.ACCESSORIES)} THEN 'ACESSORIO' WHEN {_CAT} <> -1 THEN 'EQUIPAMENTO' ELSE 'INDEFINIDO' END",
    "category": _MAIN,
    "has_model": f"list_has_any({s.model_numbers('query')}, ['510', '320'])",
}, _doc)
_over("query_specificity", "phrases", "query_id", lambda: {
    "specificity": F.round(taxonomy.specificity(F.col("query")), 6),
}, {
    "specificity": f"round(least(1.0, 0.3 + CASE WHEN len({s.model_numbers('query')}) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len({s.words('trim(query)', chr(92) + 's+')}) >= 2 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(query, '(?i)\\d{{2,}}\\s*(mm|cm|w|v|kg|l|hp|rpm)') THEN 0.1 ELSE 0 END), 6)::DOUBLE",
})
_over("bands", "part", "p_partkey", lambda: {
    "level": taxonomy.confidence_level(F.col("p_size") / 50),
    "band": taxonomy.confidence_band(F.col("p_size") * 2),
    "maintenance": taxonomy.maintenance_band(F.col("p_size") * 2 - 2),
    "sample": taxonomy.sample_quality(F.col("p_size"), F.lit(1.0), F.lit(1.0) + F.col("p_size") / 40, F.lit(1.5)),
}, {
    "level": "CASE WHEN p_size / 50.0 >= 0.8 THEN 'alta' WHEN p_size / 50.0 >= 0.6 THEN 'media' ELSE 'baixa' END",
    "band": "CASE WHEN p_size = 0 THEN 'N/A' WHEN p_size * 2 >= 80 THEN 'Excelente' WHEN p_size * 2 >= 75 THEN 'Muito Boa' WHEN p_size * 2 >= 50 THEN 'Boa' ELSE 'Ruim' END",
    "maintenance": "CASE WHEN p_size * 2 - 2 = 0 THEN 'Nenhuma' WHEN p_size * 2 - 2 <= 20 THEN 'Baixa' WHEN p_size * 2 - 2 <= 50 THEN 'Média' ELSE 'Alta' END",
    "sample": "CASE WHEN p_size < 3 THEN 'low_sample' WHEN p_size / 40.0 / 1.5 > 0.5 THEN 'high_variation' ELSE 'ok' END",
})
