from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cotejo.functions import attributes, domain, taxonomy, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (text.normalize_key, "  Aspirador de PÓ/Água 1.400W ", "aspirador de po agua 1 400w"),
        (text.sanitize, "Ação_1: Não!", "Acao_1 Nao"),
        (text.normalize_general, "Cabo-mop 1.5 ação", "cabo-mop 1.5 a o"),
        (text.strip_accents, "Ñandú Ção ß", "Nandu Cao ß"),
        (text.consonant_key, "Enceradeira Industrial", "ncrdrndstr"),
        (text.normalize_equipment, "Motor 7 CV (trifásico)", "motor 7hp trifasico"),
        (text.normalize_equipment, "ASP 1400 w", "aspirador 1400 w"),
        (text.normalize_equipment, "baldes", "bald"),
        (text.normalize_equipment, "", ""),
        (text.consonant_signature, "Motor Elétrico 220V 7.5HP", "mtrltrcvhp_22075"),
        (text.split_alphanumeric, "CL510mm", "cl 510 mm"),
    ],
)
def test_text(spark, function, given, expected):
    assert value(spark, function(F.lit(given))) == expected


@pytest.mark.parametrize(("given", "expected"), [("1.234,56", 1234.56), ("1234.56", 123456.0), ("12 un", 12.0), ("abc", None), ("", None), ("-3,5", -3.5), (None, None)])
def test_brazilian_numbers(spark, given, expected):
    assert value(spark, text.parse_br_number(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(("given", "expected"), [("R$ 1.500,00", 1500.0), ("1500.00", 1500.0), ("1,500.00", 1500.0), ("-", 0.0), ("N/A", 0.0), (None, 0.0), ("-5,00", 0.0), ("abc", 0.0)])
def test_currency(spark, given, expected):
    assert value(spark, text.parse_brl(F.lit(given).cast("string"))) == expected


def test_format_brl(spark):
    assert value(spark, text.format_brl(F.lit(1234.5))) == "R$ 1.234,50"
    assert value(spark, text.format_brl(F.lit(float("nan")))) == "R$ 0,00"


def test_ngrams_of_short_words_vanish(spark):
    assert value(spark, text.char_ngrams(F.lit("a mop"), 3, 4)) == [" a ", " mo", "mop", "op ", " mop", "mop "]
    assert value(spark, text.word_ngrams(F.lit("Mop pó"))) == ["mop", "po", "mop po"]
    assert value(spark, text.word_ngrams(F.lit(""))) == []


def test_attributes(spark):
    got = value(spark, attributes.full_attributes(F.lit("Lavadora 2000 psi 60 litros 20 in 220 V 1750 rpm a bateria")))
    assert got["capacity_l"] == 60 and got["voltage_v"] == 220 and got["rpm"] == 1750 and got["power_source"] == "battery"
    assert got["pressure_bar"] == pytest.approx(137.8952) and got["diameter_mm"] == pytest.approx(508)
    none = value(spark, attributes.full_attributes(F.lit("")))
    assert none["capacity_l"] is None and none["power_source"] is None


def test_boost_counts_only_what_the_query_asks(spark):
    boost = attributes.numeric_boost(attributes.full_attributes(F.lit("30 litros bivolt")), attributes.full_attributes(F.lit("27 litros bivolt 9 bar")))
    assert value(spark, boost) == pytest.approx((0.9 + 1) / 2)
    assert value(spark, attributes.numeric_boost(attributes.full_attributes(F.lit("x")), attributes.full_attributes(F.lit("9 bar")))) == 0


@pytest.mark.parametrize(("given", "category"), [("mop úmido", "cleaning_support"), ("enceradeira", "cleaning_core"), ("motor weg", "peripheral"), ("", "unknown"), ("cadeira azul", "unknown")])
def test_domain(spark, given, category):
    assert value(spark, domain.classify(F.lit(given)))["category"] == category


@pytest.mark.parametrize(
    ("given", "intent"),
    [("enceradeira 510 com discos", "EQUIPAMENTO"), ("disco para enceradeira", "ACESSORIO"), ("escova", "ACESSORIO"), ("mop", "EQUIPAMENTO"), ("cadeira", "INDEFINIDO"), ("", "INDEFINIDO")],
)
def test_intent(spark, given, intent):
    assert value(spark, taxonomy.parse_query(F.lit(given)))["intent"] == intent


def test_core_query_keeps_plurals_of_accessories(spark):
    q = F.lit("enceradeira de piso 510 c/ discos e escovas")
    assert value(spark, taxonomy.core_query(q, taxonomy.parse_query(q))) == "enceradeira piso 510 discos escovas"


def test_navigation(spark):
    assert value(spark, taxonomy.is_navigation(taxonomy.navigation_context(F.lit("Vassoura"))))
    assert not value(spark, taxonomy.is_navigation(taxonomy.navigation_context(F.lit("vassoura 60cm"))))


def test_a_text_is_normalised_once_a_row(spark):
    rows = spark.createDataFrame([("mop 510 c/ discos",)], "query string")
    parsed = taxonomy.parse_query(F.col("query"))
    every = [parsed, taxonomy.core_query(F.col("query"), parsed), taxonomy.navigation_context(F.col("query")), taxonomy.is_navigation(taxonomy.navigation_context(F.col("query"))), taxonomy.classify_doc(F.col("query"), F.array(F.lit("510")))]
    for column in every:
        plan = rows.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("translate(") == 1, column
