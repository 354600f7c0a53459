"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read word by word. The first transducer, the lexicon, writes each word's tag (insult,
threat, target, negation, reported speech) and its weight; the composition of five small
transducers, one per tag, carries that weight along the arc taken to one of the outputs: an insult
is plain, negated or reported, and so is a threat, by the states of the negation and the reporting
transducer. At a clause's end its final weights come out: plain insults count as targeted too, and
plain threats count at all, only if the target transducer has seen somebody addressed. Clause
outputs, not isolated words, are what a document is scored by. Clauses are read whole, however long.

Insult arcs get their weights from labelled rows: words and word beginnings whose log-odds of
standing in a toxic document are beyond chance, added to a short general list. They are learned,
like the calibration from clause outputs to a probability, on a bounded sample of the labelled
rows (``SAMPLE`` rows, those with the smallest hashed ids). How large log-odds and significance must
be is chosen by cross-validation inside that sample: of each fold, the clause outputs are those of a
lexicon learned on the other folds. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import cut, fold, release_memory, table

#: Most labelled rows that the lexicon and the calibration are fitted on.
SAMPLE = 20_000
#: Folds of the sample, and what cross-validation chooses from: least log-odds of a learned entry
#: (lower ones are those of a language or topic, not of an insult) and least log-likelihood ratio (nats).
FOLDS = 3
CHOICES = tuple((odds, ratio) for odds in (2.0, 2.75, 3.5, 4.25) for ratio in (8.0, 16.0))
#: Toxic rows that a learned entry stands in at least.
SUPPORT = 5
#: Word beginnings of these lengths are candidates besides whole words.
PREFIXES = (3, 4, 5, 6)
HELD_OUT_FOLD = 5
#: Counts that a worker holds before it hands them on.
HELD = 50_000

# General word lists of the five tags.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown worthless pathetic disgusting dumb imbecile vermin filth jerk idiota estúpido imbécil basura dummkopf abschaum crétin connard ordure".split()
THREATS = "kill hurt destroy beat shoot stab attack murder burn töten tuer matar".split()
TARGETS = "you your you're u he she they him her them his their tu vous toi te du dich ihr sie usted ustedes él ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't didn't without nicht kein keine nie ne pas jamais nunca".split()
#: After these, and after a comma, a negation holds no longer; "not only" denies nothing.
BREAKS = "but however only aber doch sondern nur mais seulement pero sino solo".split()
REPORTS = "said says say called calls claimed claims wrote quoted reported allegedly sagte sagt dit dijo".split()
#: Weight of a listed insult that no label speaks for or against.
DEFAULT_WEIGHT = 4.0

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|,")
CLAUSE_ENDS = ".!?;:|\n"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")

TAGS = {"insult": "I", "threat": "H", "target": "T", "negation": "N", "report": "R", "break": "B", "other": "o"}


@dataclass(frozen=True)
class Transducer:
    """A finite-state machine over tags: arcs (state, tag) -> state; a missing arc stays."""

    start: str
    arcs: dict[tuple[str, str], str]

    def step(self, state: str, tag: str) -> str:
        return self.arcs.get((state, tag), state)


# Each watches one thing. A reporting verb holds for the words after it in the clause, a negation
# up to a comma or a conjunction; it is used up by the insult or the threat it scopes over.
NEGATION = Transducer("affirmed", {("affirmed", "N"): "denied", ("denied", "N"): "affirmed", ("denied", "I"): "affirmed", ("denied", "H"): "affirmed", ("denied", "B"): "affirmed"})
REPORTED = Transducer("direct", {("direct", "R"): "quoting"})
TARGET = Transducer("none", {("none", "T"): "seen"})
THREAT = Transducer("calm", {("calm", "H"): "threatened"})
INSULT = Transducer("clean", {("clean", "I"): "insulted"})
MACHINES = (INSULT, THREAT, TARGET, NEGATION, REPORTED)
#: What the composed machine puts out along its arcs, and at a clause's end.
ARCS = ("plain", "negated", "reported", "threat", "threat_negated", "threat_reported")
OUTPUTS = ("plain", "negated", "reported", "targeted", "threat", "averted")


def compose(machines: tuple[Transducer, ...]) -> dict[tuple[tuple[str, ...], str], tuple[tuple[str, ...], str | None]]:
    """The product machine: (state, tag) -> (next state, the output that the word's weight goes to)."""
    states = [sorted({m.start, *(s for s, _ in m.arcs), *m.arcs.values()}) for m in machines]
    table_of = {}
    for state in product(*states):
        for tag in TAGS.values():
            then = tuple(m.step(s, tag) for m, s in zip(machines, state, strict=True))
            how = "negated" if "denied" in state else "reported" if "quoting" in state else "plain"
            out = {"I": how, "H": "threat" if how == "plain" else f"threat_{how}"}.get(tag)
            table_of[state, tag] = (then, out)
    return table_of


MACHINE = compose(MACHINES)
START = tuple(m.start for m in MACHINES)


@dataclass
class Grammar:
    """The lexicon (entries ending in * are word beginnings), and the calibration."""

    lexicon: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: list(PRIOR))
    choice: tuple[float, float] | None = None
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for entry, weight in self.lexicon.items():
                found.add_word(entry.rstrip("*"), [])
            for word in THREATS:
                found.add_word(word, [])
            for key in list(found.keys()):
                exact = self.lexicon.get(key, 1.0 if key in THREATS else None)
                found.add_word(key, (len(key), exact, self.lexicon.get(f"{key}*")))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def read(self, word: str) -> tuple[str, float]:
        """The tag of a word and its weight: an insult's is the best of the word and of its beginnings."""
        weight = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(f"{word[:k]}*", 0.0) for k in PREFIXES if len(word) > k)])
        return ("I", weight) if weight > 0 else (_GENERAL.get(word, "o"), 1.0)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coefficients": self.coefficients, "choice": self.choice, "_automaton": None}


_GENERAL = {**{w: "H" for w in THREATS}, **{w: "T" for w in TARGETS}, **{w: "N" for w in NEGATIONS}, **{w: "R" for w in REPORTS}, **{w: "B" for w in (",", *BREAKS)}}


def clause_outputs(clause: str, grammar: Grammar) -> dict[str, float]:
    """Runs the composed machine over one lower-case clause; weights by output name."""
    state, arcs = START, dict.fromkeys(ARCS, 0.0)
    for match in WORD.finditer(clause):
        tag, weight = grammar.read(match[0])
        state, name = MACHINE[state, tag]
        if name:
            arcs[name] += weight
    seen = 1.0 if "seen" in state else 0.0
    return {
        "plain": arcs["plain"], "negated": arcs["negated"], "reported": arcs["reported"], "targeted": seen * arcs["plain"],
        "threat": seen * arcs["threat"], "averted": seen * (arcs["threat_negated"] + arcs["threat_reported"]),
    }


def features(text: str | None, grammar: Grammar) -> list[float]:
    """What the calibration reads, as logarithms: all plain weight, and of each output the strongest clause's.

    Only clauses with a word of the grammar put anything out, so those that the automaton finds
    none in are passed over; each of the others is read once, from one end to the other.
    """
    low = (text or "").lower()
    automaton = grammar.automaton()
    best = dict.fromkeys(OUTPUTS, 0.0)
    total, done = 0.0, 0
    for end, (size, _, begins) in automaton.iter(low) if len(automaton) else ():
        start = end - size + 1
        if start < done or start and low[start - 1].isalpha():
            continue
        if begins is None and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        left = max(done, *(low.rfind(c, done, start) + 1 for c in CLAUSE_ENDS))
        cutter = CLAUSE_END.search(low, end + 1)
        done = cutter.end() if cutter else len(low)
        out = clause_outputs(low[left : cutter.start() if cutter else done], grammar)
        total += out["plain"]
        for name in OUTPUTS:
            best[name] = max(best[name], out[name])
    return [1.0, float(np.log1p(total)), *(float(np.log1p(best[name])) for name in OUTPUTS)]


#: What the coefficients are without labels, and what they are drawn to with few: intercept, all
#: plain weight, and the strongest plain, negated, reported, targeted clause, threat, averted threat.
PRIOR = (-3.5, 0.6, 2.0, 0.1, 0.3, 0.5, 3.6, 0.1)
PULL = 2.0


def probability(rows: np.ndarray, coefficients: list[float]) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(rows @ np.asarray(coefficients), -30, 30)))


def calibrate(rows: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> list[float]:
    """Logistic regression with a Gaussian prior around PRIOR, by Newton's method."""
    prior = np.array(PRIOR)
    at = prior.copy()
    if not len(rows):
        return list(PRIOR)
    for _ in range(rounds):
        p = probability(rows, at)
        slope = rows.T @ (toxic - p) - PULL * (at - prior)
        bend = (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + PULL * np.eye(len(at))
        step = np.linalg.solve(bend, slope)
        at = at + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    at[1:3] = np.maximum(at[1:3], 0.0)  # plain insults never speak for a text
    return [float(x) for x in at]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most ``sample`` labelled rows outside the held-out fold.

    Null labels and null ids teach nothing; of several labels of one id the largest holds, and of
    several texts of one id the least teaches.
    """
    marked = labels.where("doc_id is not null and toxic is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(fold(F.col("doc_id"), HELD_OUT_FOLD) != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most SAMPLE rows of two numbers: a bound that holds at any size
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return once.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the sample by entry, label and fold, counted once a text; summed up per task."""
    sums: Counter = Counter()

    def counted() -> pd.DataFrame:
        return pd.DataFrame({"entry": [e for e, _ in sums], "kind": [k for _, k in sums], "n": list(sums.values())}).astype({"entry": str, "kind": "int32", "n": "int64"})

    for batch in batches:
        for text, toxic, part in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
            words = set(WORD.findall(text.lower())) - {","}
            entries = {w for w in words if len(w) > 2}
            for k in PREFIXES:
                entries |= {f"{w[:k]}*" for w in words if len(w) > k}
            kind = 2 * int(part) + int(toxic)
            sums.update((e, kind) for e in entries)
            if len(sums) > HELD:
                yield counted()
                sums.clear()
    yield counted()
    sums.clear()
    release_memory()


class Evidence:
    """How often entries stand in clean and toxic rows of each fold; gives the lexicon of any folds."""

    def __init__(self, entries: list[str], counts: np.ndarray, sizes: np.ndarray):
        self.entries, self.counts, self.sizes = entries, counts, sizes  # counts: entry, fold, label

    def lexicon(self, odds: float, ratio: float, without: int | None = None) -> dict[str, float]:
        folds = [k for k in range(FOLDS) if k != without]
        good, bad = self.sizes[folds].sum(axis=0)
        lexicon = dict.fromkeys(INSULTS, DEFAULT_WEIGHT)
        if not (good and bad and len(self.entries)):
            return lexicon
        g, b = self.counts[:, folds].sum(axis=1).T.astype(float)
        n, share = np.maximum(g + b, 1.0), bad / (good + bad)
        weight = np.log((b + 0.5) / (bad + 1.0)) - np.log((g + 0.5) / (good + 1.0))
        surprise = b * np.log(np.maximum(b, 1e-9) / n / share) + g * np.log(np.maximum(g, 1e-9) / n / (1 - share))
        known = set(INSULTS)
        learned = (b >= SUPPORT) & (surprise >= ratio) & (weight >= odds)
        for k in np.flatnonzero(b >= SUPPORT).tolist():
            if learned[k] or self.entries[k] in known:
                lexicon[self.entries[k]] = round(max(0.0, float(weight[k])), 6)
        return {k: w for k, w in lexicon.items() if w > 0}


def evidence(rows: DataFrame) -> Evidence:
    """Of the sample's rows; only entries with enough toxic rows leave the executors, so the sample bounds them."""
    sizes = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], r["toxic"]] = r["count"]
    counted = rows.select("text", "toxic", "fold").mapInPandas(_candidates, "entry string, kind int, n long")
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(2 * FOLDS)]
    toxic = sum((F.col(f"k{2 * k + 1}") for k in range(FOLDS)), F.lit(0))
    found = sorted(counted.groupBy("entry").agg(*kinds).where(toxic >= SUPPORT).collect())
    counts = np.array([r[1:] for r in found], dtype=np.int64).reshape(len(found), FOLDS, 2)
    return Evidence([r[0] for r in found], counts, sizes)


def _log_loss(rows: np.ndarray, toxic: np.ndarray, part: np.ndarray) -> float:
    """Of each fold, by the calibration on the others."""
    lost = 0.0
    for k in range(FOLDS):
        inside = part == k
        p = np.clip(probability(rows[inside], calibrate(rows[~inside], toxic[~inside])), 1e-9, 1 - 1e-9)
        lost -= float((toxic[inside] * np.log(p) + (1 - toxic[inside]) * np.log(1 - p)).sum())
    return lost


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, choices: tuple[tuple[float, float], ...] = CHOICES) -> Grammar:
    """The grammar fitted on the bounded sample; the general list alone if there are no labels of both kinds."""
    rows = cut(training_rows(docs, labels, sample))
    known = evidence(rows)
    if not known.sizes.sum(axis=0).all():
        return Grammar(dict.fromkeys(INSULTS, DEFAULT_WEIGHT))
    grammars = [[Grammar(known.lexicon(*choice, without=k)) for choice in choices] for k in range(FOLDS)]

    def of_other_folds(texts: pd.Series, parts: pd.Series) -> pd.Series:
        out = pd.Series([[x for g in grammars[k] for x in features(t, g)] for t, k in zip(texts, parts, strict=True)])
        release_memory()
        return out

    # numbers of at most SAMPLE rows
    read = rows.select("doc_id", "toxic", "fold", F.pandas_udf(of_other_folds, T.ArrayType(T.DoubleType()))("text", "fold").alias("x")).orderBy("doc_id").collect()
    toxic, part = np.array([r["toxic"] for r in read], dtype=float), np.array([r["fold"] for r in read])
    every = np.array([r["x"] for r in read]).reshape(len(read), len(choices), len(PRIOR))
    best = int(np.argmin([_log_loss(every[:, k], toxic, part) for k in range(len(choices))]))
    return Grammar(known.lexicon(*choices[best]), calibrate(every[:, best], toxic), choices[best])


def _score_udf(grammar: Grammar):
    def run(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t, grammar) for t in texts]).reshape(len(texts), len(PRIOR))
        release_memory()
        return pd.Series(probability(rows, grammar.coefficients))

    return F.pandas_udf(run, T.DoubleType())


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    A null or empty text gets the score of a text without any match. Repeated rows each get a row
    and the same score; a null id counts as empty text for the fold. Other columns are ignored.
    An empty table gives no rows; without labels of both kinds the general list and PRIOR score.
    """
    scored = docs.select("doc_id", _score_udf(grammar)("text").alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLD) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` without the rows whose whole text scores 0.5 or more."""
    return docs.where(_score_udf(grammar)(docs["text"]) < 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
