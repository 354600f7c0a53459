"""Quality rules of documents: a table of thresholds compiled into one projection, in DataFrame functions only.

A rule says between which bounds, in thousandths, a ratio of two counts must lie, and from which size of the lower count on
it is asked at all, so that a short text is not judged by ratios of a few words. Counts and
comparisons are whole numbers, so a verdict never hangs on rounding. Nothing is shuffled: every count
of a text is made from the text's own row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import WORD_PATTERN, table

#: Fixed values of the base rules: words of a window, words a text needs, percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = r"[#*$%&|<>]+"
#: What may stand around a word without making it another.
MARKS = ".,;:!?\"'()[]"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = """
the of and a in to is that it for on with as was by be this are from at an or
der die und den von zu das mit sich des auf für ist im ein eine dem nicht
le la les de et à un une en du que est dans pour au pas par sur
el los las del y se por con para una no lo su al es
""".split()


@dataclass(frozen=True)
class Rule:
    """1000 * top / bottom must lie within low and high (None: no bound) where bottom is at least ``least``."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None
    least: int = 1

    def fails(self, count: Callable[[str], object]):
        """The condition under which a text fails, from a function that gives a count by its name."""
        top, bottom = count(self.top) * 1000, count(self.bottom)
        bounds = [top < bottom * self.low] * (self.low is not None) + [top > bottom * self.high] * (self.high is not None)
        return (bottom >= self.least) & reduce(lambda x, y: x | y, bounds)

    def sql(self) -> str:
        bounds = [f"1000 * {self.top} < {self.low} * {self.bottom}"] * (self.low is not None) + [f"1000 * {self.top} > {self.high} * {self.bottom}"] * (self.high is not None)
        return f"({self.bottom} >= {self.least} AND ({' OR '.join(bounds)}))"


#: The table of thresholds; any other one can be given to ``verdicts``.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=12_000, least=20),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("exclamations", "n_exclamations", "n_words", high=500),
    Rule("stop_words", "n_stop_words", "n_words", low=50, least=25),
    Rule("distinct_words", "n_distinct_words", "n_words", low=350, least=10),
    Rule("doubled_words", "n_doubled_words", "n_words", high=200),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=300, least=8),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=300, least=3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900, least=3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _made(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A select whose new columns are made once a row: behind a generator, neither a later filter nor
    a lambda that uses them can pull their making into itself."""
    made = [c for c in columns if not isinstance(c, str)]
    return df.select(*[c for c in columns if isinstance(c, str)], F.inline(F.array(F.struct(*made))))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _windows(words: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of the start (from 0) of each window of words; null for fewer words than a window has."""
    last = F.size(words) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), made))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows that stand twice or more among ``words``, which must be a column.

    Windows whose hashes are all different are all different. Only other texts have their windows
    compared in full, sorted, so that equal ones are neighbours.
    """
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]  # noqa: E731  # a slice would copy all words

    def again(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["window"] == x["window"], F.lit(False))
        return F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["start"])

    def covered(starts: Column) -> Column:
        return _total(F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)))))

    texts = _windows(words, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("window"), i.alias("start")))
    slowly = _let(F.sort_array(_let(F.sort_array(texts), again)), covered)
    differ = _let(_windows(words, lambda i: F.xxhash64(*window(i))), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < WINDOW, 0).when(differ, 0).otherwise(slowly).cast("long")


def _without(text: Column, pattern: str) -> Column:
    """How many code points of a text a pattern takes."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and every count that a rule may name, for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = _made(
        docs, "doc_id",
        F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_PATTERN)).alias("lines"),
    )
    cut = _made(cut, "doc_id", "words", "lines", F.array_join("words", "").alias("joined"))
    stops = [w for word in STOP_WORDS for w in (word, word.capitalize(), word.upper())]
    size = lambda items: F.size(items).cast("long")
    words, lines = F.col("words"), F.col("lines")
    return _made(
        cut, "doc_id",
        size(words).alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        _without(F.col("joined"), SYMBOLS).alias("n_symbols"),
        (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        size(lines).alias("n_lines"),
        _without(F.col("joined"), "!+").alias("n_exclamations"),
        size(F.filter(words, lambda w: F.btrim(w, F.lit(MARKS)).isin(stops))).alias("n_stop_words"),
        size(F.array_distinct(words)).alias("n_distinct_words"),
        size(F.filter(words, lambda w, k: F.coalesce(F.get(words, k - 1) == w, F.lit(False)))).alias("n_doubled_words"),
        size(F.filter(lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))).alias("n_cut_lines"),
        size(F.filter(lines, lambda line: line.rlike(r"\A[\x20\x09-\x0D]*[-*•·]"))).alias("n_bullet_lines"),
    )


def verdicts(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its counts, base_failed, failed_rules and kept.

    A null, empty or wordless text has no word and fails the base, as does any of fewer than ten
    words. Texts may have any length: a text's own windows are the most that is held at once, about
    five times the text, and only where some window repeats. Repeated rows and ids have
    a row each; null ids stay null; other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    found = counts(docs)
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    failed = F.concat_ws(",", *[F.when(rule.fails(F.col), F.lit(rule.name)) for rule in rules])
    judged = found.select("*", base.alias("base_failed"), failed.alias("failed_rules"))
    return judged.select("*", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "failed_rules")


def _oracle() -> str:
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
    stops = ", ".join("'" + w + "'" for word in STOP_WORDS for w in dict.fromkeys((word, word.capitalize(), word.upper())))
    marks = MARKS.replace("'", "''")
    failed = ", ".join(f"CASE WHEN {rule.sql()} THEN '{rule.name}' END" for rule in RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut)),
places AS (
  SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS place
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(*) AS n FROM places GROUP BY r),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(array_to_string(w, ''), '[^!]+', '', 'g')) AS n_exclamations,
         len(list_filter(w, lambda x: trim(x, '{marks}') IN ({stops}))) AS n_stop_words,
         len(list_distinct(w)) AS n_distinct_words,
         len(list_filter(list_zip(w[2:], w[1:len(w) - 1]), lambda x: x[1] = x[2])) AS n_doubled_words,
         len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){blank}$'))) AS n_cut_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^{blank}[-*•·]'))) AS n_bullet_lines
  FROM cut LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept,
       n_stop_words, n_lines, failed_rules
FROM judged"""


ORACLE_SQL = _oracle()
