"""Secret scans with multipart credential linking, in DataFrame functions only.

Base matches are leftmost and non-overlapping per kind. Their positions come from the gaps that
splitting a text by the same pattern leaves: a match starts where the gaps and matches before it
end. Positions count code points and ends are exclusive.

Linking joins the intervals of parts with those of scopes. A scope is a block of lines without a
blank line between them, of any length; no part goes beyond its line, so each is in one scope.
Parts of a credential are its access identifiers, its secrets (assignments, or long strings that
might be one) and its endpoints (service addresses). A weak part, a string or an address that proves
nothing by itself, is reported only if a complementary part is in its scope: a string with an access
identifier, an address with an identifier or an assigned secret. Strings that lie inside another
part are found by one sweep over the parts in order of their starts.

All of it runs inside each row, so nothing is shuffled. Sums and maxima along a list are taken by
parts of about the square root of its length, so a text with very many matches costs little more
than in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import table

# The base patterns. Runs below their least length are dropped; for the two that
# are runs of one class the length stands in the pattern, for assign it is checked afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
ANY = f"(?:{ASSIGN})|(?-i:{ACCESS}|{HEX})"
#: What ends a scope: a line's end before a blank line.
BLANK = r"\n[ \t]*(?=\n)"

# What may be part of a credential.
STRING = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i)(?:https?|s3|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>|]+"
KINDS = ("assign", "access", "hex", "string", "endpoint")
MASK = "[SECRET]"


_EMPTY = "array<struct<start:int,end:int,part:string>>"
#: Code points of the pieces that a text is cut into where many short pieces of it are needed.
PIECE = 4_096


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _fold(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """struct<at, before>: the total of non-negative values, and of each what stood before it."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(values, state, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Of each value the total of those before it: sums, or what else joins parts as it joins values."""

    def by_parts(v: Column, width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), (F.ceil(F.size(v) / width) - 1).cast("int")), lambda k: _fold(F.slice(v, k * width + 1, width), step))
        return _let(parts, lambda p: F.flatten(F.zip_with(p, _fold(F.transform(p, lambda x: x["at"]), step)["before"], lambda x, before: F.transform(x["before"], lambda y: step(before, y)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: by_parts(v, width))).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, offset: Column, group: int = 0) -> Column:
    """array<struct<start, end, part>> of all matches, from an offset on; part is the given group's text."""

    def placed(gaps: Column, whole: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        sizes = F.transform(whole, F.length)
        before = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), sizes, lambda gap, size: gap + size))
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), sizes.alias("size"), parts.alias("part"), before.alias("before"))
        start = lambda x: offset + x["before"] + x["gap"]
        return F.transform(zipped, lambda x: F.struct(start(x).alias("start"), (start(x) + x["size"]).alias("end"), x["part"].alias("part")))

    found = _let(F.transform(F.split(text, pattern, -1), F.length), lambda gaps: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: placed(gaps, whole)))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(_EMPTY))


def _scopes(text: Column) -> Column:
    """array<struct<offset, text>> of the blocks of a text."""
    ends = F.regexp_extract_all(text, F.lit(BLANK), F.lit(0))

    def placed(blocks: Column) -> Column:
        sizes = F.zip_with(blocks, ends, lambda b, e: F.length(b) + F.coalesce(F.length(e), F.lit(0)))
        return F.zip_with(running(sizes), blocks, lambda at, b: F.struct(at.alias("offset"), b.alias("text")))

    return _let(F.split(text, BLANK, -1), placed)


def _outside(strings: Column, others: Column) -> Column:
    """The strings that no other part reaches over, by one sweep in order of starts."""
    start = lambda s, weak: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(weak).alias("weak"), s["part"].alias("part"))

    def swept(order: Column) -> Column:
        reach = running(F.transform(order, lambda s: F.when(s["weak"], 0).otherwise(-s["back"])), F.greatest)
        return F.zip_with(order, reach, lambda s, r: F.struct(s.alias("s"), (s["weak"] & (r < -s["back"])).alias("free")))

    every = _let(F.array_sort(F.concat(F.transform(others, lambda s: start(s, False)), F.transform(strings, lambda s: start(s, True)))), swept)
    return F.transform(F.filter(every, lambda x: x["free"]), lambda x: F.struct(x["s"]["start"].alias("start"), (-x["s"]["back"]).alias("end"), x["s"]["part"].alias("part")))


def _parts(scope: Column) -> Column:
    """The parts of one scope, of each kind those that are reported."""
    text, offset = scope["text"], scope["offset"]
    assign = F.filter(_spans(text, ASSIGN, offset, 2), lambda s: F.length(s["part"]) >= ASSIGN_LEAST)
    return F.struct(assign.alias("assign"), _spans(text, ACCESS, offset).alias("access"), _spans(text, HEX, offset).alias("hex"), text.alias("text"), offset.alias("offset"))


def _linked(parts: Column) -> Column:
    """With the weak parts whose complements are there."""
    empty = F.array().cast(_EMPTY)
    mixed = lambda s: s["part"].rlike("[0-9]") & s["part"].rlike("[A-Z]") & s["part"].rlike("[a-z]")
    strings = F.filter(_spans(parts["text"], STRING, parts["offset"]), mixed)
    string = F.when(F.size(parts["access"]) > 0, _outside(strings, F.concat(parts["assign"], parts["access"], parts["hex"]))).otherwise(empty)
    endpoint = F.when(F.size(parts["access"]) + F.size(parts["assign"]) > 0, _spans(parts["text"], ENDPOINT, parts["offset"])).otherwise(empty)
    return F.struct(*[parts[k].alias(k) for k, _ in BASE], string.alias("string"), endpoint.alias("endpoint"))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found for every row of ``docs`` (doc_id, text).

    spans lists kind:start:end of base and linked matches by start, then kind; found holds them as
    an array of (start, rank, end). A null text is empty and gives zero counts and empty lists.
    Repeated rows each get the same result; other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # nothing is linked but to a base match, so other texts and scopes are passed over
    scopes = F.when(F.regexp_like(text, F.lit(ANY)), F.filter(_scopes(text), lambda s: F.regexp_like(s["text"], F.lit(ANY))))
    rows = docs.select("doc_id", F.coalesce(F.transform(scopes, _parts), F.array()).alias("parts"))
    rows = rows.select("doc_id", F.transform("parts", _linked).alias("linked"))
    rows = rows.select("doc_id", *[F.flatten(F.col("linked")[k]).alias(k) for k in KINDS])
    base = F.concat(*[_named(k, F.col(k)) for k, _ in BASE])
    every = F.concat(*[_named(k, F.col(k)) for k in KINDS])
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, _ in BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.array_sort(every).alias("found"),
    )


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every found span replaced by the mask; n_chars follows where there is such a column.

    Overlapping spans are replaced as one. Texts without a find, null ones included, stay as they
    are; repeated rows are masked alike; no rows give no rows.
    """
    found = scan(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    text = F.col("doc_id.text")
    pieces = F.transform(F.sequence(F.lit(0), (F.length(text) / PIECE).cast("int")), lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE)))
    found = found.select("doc_id", "found", F.when(F.size("found") > 0, pieces).alias("pieces"), running(F.transform("found", lambda s: s["end"]), F.greatest).alias("reach"))

    def between(start: Column, end: Column) -> Column:
        """A stretch of the text, from the piece that it lies in where it lies in one."""
        at = (start / PIECE).cast("int")
        inside = F.substring(F.element_at("pieces", at + 1), start - at * PIECE + 1, end - start)
        return F.when(end <= start, "").when(end <= (at + 1) * PIECE, inside).otherwise(F.substring(text, start + 1, end - start))

    masked = F.zip_with("found", "reach", lambda s, before: F.when(s["start"] >= before, F.concat(between(before, s["start"]), F.lit(mask))).otherwise(""))
    clean = F.concat(F.array_join(masked, ""), between(F.array_max(F.transform("found", lambda s: s["end"])), F.length(text)))
    out = found.select("doc_id", F.when(F.size("found") > 0, clean).otherwise(text).alias("clean"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("clean").alias("text"))
        elif name == "n_chars":
            columns.append(F.when(F.col("clean").isNull(), F.col("doc_id.n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("doc_id").getField(name).alias(name))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
