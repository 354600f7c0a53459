"""Whether a text is about cleaning machines, things used with them, or neither."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import first_text, normalize_equipment

# Words of the three categories, and patterns of a motor that stands alone.
CORE = [
    "lavadora de piso", "lavadora piso", "auto lavadora", "autolavadora", "auto-lavadora", "scrubber", "auto-scrubber", "autoscrubber", "lavadora de pisos", "maquina lavar piso",
    "aspirador", "aspiradora", "aspiradores", "aspira po", "aspira agua", "aspirador agua e po", "aspirador industrial", "aspirador de po", "vacuum",
    "extratora", "extrator", "extratoras", "carpet extractor", "extratora de carpete",
    "hidrojato", "hidrojateadora", "hidro jato", "lavadora alta pressao", "lavadora de alta pressao", "lavadora pressao", "pressure washer",
    "enceradeira", "enceradeiras", "politriz", "polisher", "single disc", "single-disc", "monodisco", "mono disco", "disco unico",
    "varredeira", "varredeiras", "vassoura mecanica", "sweeper",
]
SUPPORT = [
    "mop", "refil mop", "cabo mop", "mop plano", "mop po", "esfregao", "esfregona",
    "balde", "baldes", "balde espremedor", "espremedor", "balde duplo", "bucket",
    "carrinho funcional", "carrinho limpeza", "carrinho de limpeza", "carro funcional", "trolley", "cart",
    "disco para", "pad para", "disco enceradeira", "pad enceradeira", "disco limpeza", "fibra abrasiva", "lixa para piso", "disco de", "pad de",
    "vassoura", "rodo", "rodinho", "pa de lixo", "pa coletora", "pano", "flanela", "squeegee", "broom",
    "espremedor de mop", "prensa", "suporte", "placa",
]
PERIPHERAL = [
    "celular", "smartphone", "telefone", "iphone", "android",
    "notebook", "laptop", "computador", "desktop", "pc", "tablet",
    "relogio de ponto", "radio", "walkie talkie", "walkie-talkie",
    "escada", "ladder",
]
MOTOR = [r"motor\s+\d+\s*hp", r"motor\s+\d+\s*cv", r"motor\s+trifasico", r"motor\s+monofasico", r"motor\s+eletrico", r"motor\s+weg", r"^\s*motor\s+"]

# How well a document's category (columns) suits a query's (rows).
SUITS = {
    "cleaning_core": {"cleaning_core": 1.0, "cleaning_support": 0.85, "unknown": 0.6, "peripheral": 0.2},
    "cleaning_support": {"cleaning_support": 1.0, "cleaning_core": 0.8, "unknown": 0.6, "peripheral": 0.3},
    "peripheral": {"peripheral": 1.0, "unknown": 0.7, "cleaning_support": 0.4, "cleaning_core": 0.3},
    "unknown": {"cleaning_core": 0.8, "cleaning_support": 0.75, "unknown": 0.6, "peripheral": 0.4},
}


def alternation(terms: list[str]) -> str:
    return "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms)


def classify(x: Column, core: list[str] = CORE, support: list[str] = SUPPORT, peripheral: list[str] = PERIPHERAL) -> Column:
    """struct<category, confidence>: support words are looked for first, then core, then peripheral, then motors."""
    norm = normalize_equipment(x)

    def kind(category: str, confidence: float) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))

    has = lambda terms: F.regexp_like(norm, F.lit(alternation(terms)))
    return (
        F.when(F.coalesce(norm, F.lit("")) == "", kind("unknown", 0.1))
        .when(has(support), kind("cleaning_support", 0.9))
        .when(has(core), kind("cleaning_core", 0.95))
        .when(has(peripheral), kind("peripheral", 0.9))
        .when(norm.contains("motor") & F.regexp_like(norm, F.lit("|".join(MOTOR))), kind("peripheral", 0.85))
        .otherwise(kind("unknown", 0.3))
    )


def classify_document(text: Column, raw_text: Column) -> Column:
    return classify(F.coalesce(first_text(text, raw_text), F.lit("")))


def domain_score(query: Column, document: Column) -> Column:
    """Suitability in [0, 1], half of it by the product of both confidences."""
    table = F.create_map(*[x for q, row in SUITS.items() for d, v in row.items() for x in (F.lit(f"{q}>{d}"), F.lit(v))])
    base = table[F.concat_ws(">", query["category"], document["category"])]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (0.5 + 0.5 * query["confidence"] * document["confidence"])))
