"""Attributes of equipment in free text, and how well two sets of them agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import normalize_general

NUMBER = r"(\d+[.,]?\d*)"
# Conversions to litres, bar and millimetres.
GALLON, PSI, INCH = 3.78541, 0.0689476, 25.4
VOLTS = r"(?i)\b(110|127|220|230|240|12|24)\s*v\b|\bbivolt\b"

# Words that name a source of power, in the order they are looked for.
POWER = {
    "battery": ["battery", "bateria", "baterias", "lithium", "li-ion", "chumbo", "acido", "ácido"],
    "electric": ["eletric", "eletrico", "elétrico", "cord", "corded", "tomada"],
    "lpg": ["lpg", "glp", "gas", "gás"],
}


def _measure(x: Column, unit: str) -> Column:
    found = F.regexp_extract(x, rf"(?i){NUMBER}\s*(?:{unit})\b", 1)
    return F.regexp_replace(found, ",", ".").try_cast("double")


def contains_any(x: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | x.contains(term)
    return out


def full_attributes(x: Column) -> Column:
    """struct<capacity_l, pressure_bar, diameter_mm, voltage_v:int, is_bivolt, rpm, power_source> of a text."""
    low = normalize_general(x)
    capacity = F.coalesce(_measure(x, "l|litros?|liter|liters?"), _measure(x, "gal|gallon|gallons") * GALLON)
    pressure = F.coalesce(_measure(x, "psi") * PSI, _measure(x, "bar"))
    diameter = F.coalesce(_measure(x, 'in|inch|inches|"') * INCH, _measure(x, "mm"))
    volts = F.lower(F.regexp_extract(x, VOLTS, 0))
    power = F.lit(None).cast("string")
    for name, terms in reversed(POWER.items()):
        power = F.when(contains_any(low, terms), name).otherwise(power)
    return F.struct(
        capacity.alias("capacity_l"),
        pressure.alias("pressure_bar"),
        diameter.alias("diameter_mm"),
        F.regexp_extract(volts, r"^\d+", 0).try_cast("int").alias("voltage_v"),
        (volts == "bivolt").alias("is_bivolt"),
        _measure(x, "rpm").alias("rpm"),
        power.alias("power_source"),
    )


def simple_attributes(x: Column) -> Column:
    """struct<voltagem, tamanho_m>: nominal voltage as text, and the first length in metres."""
    low = normalize_general(x)
    volts = F.regexp_extract(low, r"(\b110\b|\b127\b|\b220\b|bivolt)", 1)
    size = F.regexp_replace(F.regexp_extract(low, r"(\d+[.,]?\d*)\s*(mm|cm|m)", 1), ",", ".").try_cast("double")
    unit = F.regexp_extract(low, r"(\d+[.,]?\d*)\s*(mm|cm|m)", 2)
    metres = F.when(unit == "mm", size / 1000).when(unit == "cm", size / 100).otherwise(size)
    return F.struct(F.when(volts != "", volts).alias("voltagem"), metres.alias("tamanho_m"))


def merged_attributes(x: Column) -> Column:
    simple, full = simple_attributes(x), full_attributes(x)
    names = ["capacity_l", "pressure_bar", "diameter_mm", "voltage_v", "is_bivolt", "rpm", "power_source"]
    return F.struct(simple["voltagem"].alias("voltagem"), simple["tamanho_m"].alias("tamanho_m"), *[full[n].alias(n) for n in names])


def numeric_boost(query: Column, item: Column) -> Column:
    """Mean agreement over the attributes that the query has; 0 if it has none.

    Capacity, pressure and diameter count by their ratio from 0.8 on, rpm from 0.9 on, voltage by
    equality. A ratio of two zeros counts nothing.
    """
    total, gained = F.lit(0), F.lit(0.0)
    for name, least in (("capacity_l", 0.8), ("pressure_bar", 0.8), ("diameter_mm", 0.8), ("rpm", 0.9)):
        ratio = F.try_divide(F.least(query[name], item[name]), F.greatest(query[name], item[name]))
        total = total + query[name].isNotNull().cast("int")
        both = query[name].isNotNull() & item[name].isNotNull()
        gained = gained + F.when(both & (ratio >= least), ratio).otherwise(0.0)
    asked = query["voltage_v"].isNotNull() | query["is_bivolt"]
    same = (query["is_bivolt"] & item["is_bivolt"]) | F.coalesce(query["voltage_v"] == item["voltage_v"], F.lit(False))
    total = total + asked.cast("int")
    gained = gained + F.when(asked & same, 1.0).otherwise(0.0)
    return F.when(total > 0, gained / F.greatest(total, F.lit(1))).otherwise(0.0)
