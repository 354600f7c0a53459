"""Language-model scoring with Brown classes.

Frequent words are put into classes by exchange clustering: a unit (a frequent word, or a shape that
stands for all other words of that ending) moves to the class where the likelihood of the class
bigrams is largest, until no unit moves. How many words are units grows with the corpus. Every other
word then gets the class that most raises that likelihood given the classes of its own neighbours,
each word for itself in the cluster; a shape's class is only that of neighbours that have no class
yet, and of words that no training text has. Class transitions are counted anew with the final
classes of all words. A text's probability is the product of class transitions and of word emissions
within classes, both smoothed; its end is a token with a class of its own. Perplexity is that
probability's inverse per token.

Counts cover every word of every training text: words are counted in each task and summed by word
over the cluster, and unit pairs likewise. Only bounded or slowly growing tables reach the driver
or all executors: the ``KNOWN`` most frequent words and the pairs of units. Counts and classes of
all other words stay distributed; texts meet them in a join by word.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import cut, fold, table

HELD_OUT_FOLD, HELD_OUT = 7, 2
#: Units that are frequent words at least, up to so many tokens, and shapes for all other words.
CLUSTERED, CLUSTERED_TOKENS, SHAPES = 2_000, 10_000_000, 256
CLASSES = 64
#: Most frequent words whose counts every executor holds; longer words than this stay out.
KNOWN, KNOWN_BYTES = 300_000, 64
#: Weight of the class unigram in the smoothed transitions, in observations.
PRIOR = 8.0
#: Words or counts that a task remembers at a time, besides the known words.
_HELD = 250_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _texts(docs: DataFrame) -> DataFrame:
    """Texts as they stand in memory, so that workers need not decode and encode them."""
    return docs.select(F.col("text").cast("binary").alias("text"))


def clustered_of(tokens: int) -> int:
    """How many words are clustered by exchange: more with the fourth root of the tokens."""
    return int(CLUSTERED * max(1.0, tokens / CLUSTERED_TOKENS) ** 0.25)


def shape_of(word: bytes) -> int:
    """The shape of a word that is no unit itself: its ending, and whether punctuation follows."""
    stem = word.rstrip(b".,;:!?|")
    return zlib.crc32(stem[-3:]) % (SHAPES // 2) * 2 + (len(stem) < len(word))


class _Ids(dict):
    """word -> number; words outside get base + shape, remembered up to a bound."""

    def __init__(self, words: list[bytes], base: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.base, self.most = base, max(_HELD, len(words) + 200_000)

    def __missing__(self, word: bytes) -> int:
        found = self.base + shape_of(word)
        if len(self) < self.most:
            self[word] = found
        return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            sums.update(words_of(text))
            if len(sums) > _HELD:
                yield pd.DataFrame({"word": list(sums), "n": list(sums.values())})
                sums = Counter()
    yield pd.DataFrame({"word": list(sums), "n": list(sums.values())}, dtype=object)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all words of all training texts; words are bytes, lower-case in A-Z."""
    return _texts(training).mapInPandas(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


#: Counts of keys (pairs of units, or words and classes) go by blocks of about so many keys.
BLOCK = 1 << 16


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and their counts, byte plane by byte plane, compressed."""
    planes = (np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(keys, prepend=0), n))
    return zlib.compress(b"".join(planes), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, 8, -1)
    steps, n = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes)
    return np.cumsum(steps), n


class _Counts:
    """Counts of keys in one task: sorted arrays, given out in blocks when they get many."""

    def __init__(self, span: int):
        self.span, self.keys, self.n, self.waiting, self.size = span, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, *keys: np.ndarray) -> Iterator[pd.DataFrame]:
        self.waiting += keys
        self.size += sum(map(len, keys))
        if self.size > 1_000_000:
            self._merge()
            if len(self.keys) > 2_000_000:
                yield from self.blocks()

    def _merge(self) -> None:
        new, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.size = [], 0
        if not len(self.keys) or not len(new):
            self.keys, self.n = (new, counts.astype(np.int64)) if len(new) else (self.keys, self.n)
            return
        keys = np.concatenate((self.keys, new))
        order = np.argsort(keys, kind="stable")  # two ascending runs
        keys, n = keys[order], np.concatenate((self.n, counts))[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys, self.n = keys[first], np.add.reduceat(n, first)

    def blocks(self) -> Iterator[pd.DataFrame]:
        if self.waiting:
            self._merge()
        if not len(self.keys):
            return
        block = self.keys // self.span
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = [*starts[1:].tolist(), len(block)]
        packed = [_packed(self.keys[a:b] - block[a] * self.span, self.n[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
        yield pd.DataFrame({"block": block[starts].astype("int32"), "packed": packed})
        self.keys, self.n = self.keys[:0], self.n[:0]


def _summed(counted: DataFrame, span: int, use: Callable[[int, np.ndarray], pd.DataFrame | None], schema: str) -> DataFrame:
    """Adds up the blocks (block, packed); ``use`` makes rows of each. A task holds its blocks as arrays, whatever their number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch["block"], batch["packed"], strict=True):
                keys, n = _unpacked(packed)
                sums.setdefault(block, np.zeros(span, np.int64))[keys] += n
        for block, n in sums.items():
            made = use(block, n)
            if made is not None and len(made):
                yield made

    parts = max(64, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return counted.repartition(parts, "block").mapInPandas(run, schema)


def _pairs_of(units: list[bytes]):
    end = len(units) + SHAPES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts = _Ids(units, len(units)), _Counts(BLOCK)
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                row = np.concatenate(([end], np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), [end]))
                yield from counts.add(row[:-1] * (end + 1) + row[1:])
        yield from counts.blocks()

    return run


def _pair_matrix(training: DataFrame, units: list[bytes], kind: type) -> np.ndarray:
    """Counts of neighbouring units; the driver holds one matrix of them, which grows with the number of units only."""
    size = len(units) + SHAPES + 1
    whole = lambda block, n: pd.DataFrame({"block": [block], "packed": [_packed(np.flatnonzero(n), n[n > 0])]})
    schema = "block int, packed binary"
    sums = cut(_summed(_texts(training).mapInPandas(_pairs_of(units), schema), BLOCK, whole, schema))
    pairs = np.zeros(size * size, kind)
    parts = 1 + size * size // 16_000_000
    for part in range(parts):
        for row in sums.where(F.col("block") % parts == part).collect():
            keys, n = _unpacked(row["packed"])
            pairs[keys + row["block"] * BLOCK] = n
    return pairs.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int, rounds: int | None = None) -> np.ndarray:
    """The class of each unit; the last unit (the end) keeps class 0 to itself.

    ``pairs`` holds the counts of unit pairs. The objective is the class bigram likelihood, sum of
    N(g,h) log N(g,h) less the sums of N log N of the classes as left and as right neighbour. Every
    move raises it, so without a limit of rounds this ends when no unit moves.
    """
    size = len(pairs)
    mass = pairs.sum(axis=0, dtype=np.float64)
    order = np.argsort(-mass[:-1], kind="stable")
    of = np.zeros(size, np.int64)
    of[order] = 1 + np.arange(size - 1) % (classes - 1)
    after = np.stack([pairs[:, of == k].sum(axis=1, dtype=np.float64) for k in range(classes)], axis=1)  # unit, class to its right
    before = np.stack([pairs[of == k].sum(axis=0, dtype=np.float64) for k in range(classes)], axis=1)  # unit, class to its left
    both = np.eye(classes)[of].T @ after
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = 0
        for w in order:
            if not mass[w]:
                continue
            a, own = of[w], float(pairs[w, w])
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            both[a] -= right
            both[:, a] -= left
            both[a, a] -= own
            rows, columns = both.sum(axis=1), both.sum(axis=0)
            gain = (_xlogx(both + right) - _xlogx(both)).sum(axis=1) + (_xlogx(both + left[:, None]) - _xlogx(both)).sum(axis=0)
            d = np.diagonal(both)
            gain += _xlogx(d + right + left + own) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            out, into = right.sum() + own, left.sum() + own
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            both[b] += right
            both[:, b] += left
            both[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if not moved:
            break
    return of


def best_classes(into: np.ndarray, out: np.ndarray, now: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The class of each word outside the units that most raises the class bigram likelihood.

    ``into`` and ``out`` count the classes of each word's left and right neighbours, a row a word.
    ``now`` is the class in which ``both`` counts the word so far; the word is taken out of it
    before, as in ``exchange``.
    """
    size = len(now)
    rows, columns, d = (np.tile(x, (size, 1)) for x in (both.sum(axis=1), both.sum(axis=0), np.diagonal(both)))
    gain = np.zeros(into.shape)
    each = np.arange(size)
    for mine, other, table in ((out, into, both), (into, out, both.T)):
        w, h = np.nonzero(mine)
        for at in range(0, len(w), 50_000):
            some, to = w[at : at + 50_000], h[at : at + 50_000]
            count = mine[some, to]
            base = table[:, to].T.copy()
            a = now[some]
            base[np.arange(len(some)), a] -= count + np.where(to == a, other[some, to], 0.0)
            np.maximum(base, 0.0, out=base)
            rise = _xlogx(base + count[:, None]) - _xlogx(base)
            first = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            gain[some[first]] += np.add.reduceat(rise, first, axis=0)
    total = out.sum(axis=1)
    rows[each, now] -= total
    columns[each, now] -= total
    d[each, now] -= out[each, now] + into[each, now]
    for x in (rows, columns, d):
        np.maximum(x, 0.0, out=x)
    gain += _xlogx(d + out + into) + _xlogx(d) - _xlogx(d + out) - _xlogx(d + into)
    total = total[:, None]
    gain -= _xlogx(rows + total) - _xlogx(rows) + _xlogx(columns + total) - _xlogx(columns)
    gain[:, 0] = -np.inf
    return np.argmax(gain, axis=1)


def _neighbours(known: list[bytes], kinds: np.ndarray, units: int, classes: int):
    """(block, packed, word, code): neighbours of words that are no units, in one pass.

    Those of known words are counts with the classes to their left, and to their right, in blocks. A
    word that isn't known has a row at each place: the class to the left, times classes, and that to the right. Words
    too long to be known may be frequent all the same, so their equal rows are counted before they are
    sent; a row's block is less than zero by how many it stands for.
    """
    base, sides = len(known), 2 * classes

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(word=None, code=np.int32(-1))

    def places(rare: list[bytes], codes: list[np.ndarray]) -> pd.DataFrame:
        every = np.concatenate(codes)
        long = np.fromiter((len(w) > KNOWN_BYTES for w in rare), bool, len(rare))
        once = np.flatnonzero(~long).tolist()
        several = Counter((rare[k], int(every[k])) for k in np.flatnonzero(long).tolist())
        words = [rare[k] for k in once] + [w for w, _ in several]
        code = np.concatenate((every[once], np.fromiter((c for _, c in several), np.int64, len(several)))).astype("int32")
        n = np.concatenate((np.ones(len(once), np.int32), np.fromiter(several.values(), np.int32, len(several))))
        return pd.DataFrame({"block": -n, "packed": np.full(len(words), None), "word": pd.Series(words, dtype=object), "code": code})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts = _Ids(known, base), _Counts(BLOCK // sides * sides)
        rare: list[bytes] = []
        codes: list[np.ndarray] = []
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                row = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                around = np.concatenate(([0], kinds[row], [0]))
                at = np.flatnonzero((row >= units) & (row < base))
                place = row[at] * sides
                yield from blocks(counts.add(place + around[at], place + classes + around[at + 2]))
                at = np.flatnonzero(row >= base)
                if len(at):
                    rare += [words[k] for k in at.tolist()]
                    codes.append(around[at] * classes + around[at + 2])
                if len(rare) > 100_000:
                    yield places(rare, codes)
                    rare, codes = [], []
        if rare:
            yield places(rare, codes)
        yield from blocks(counts.blocks())

    return run


def _assigned_known(known: list[bytes], both: np.ndarray, shape_class: np.ndarray):
    """(place, k) of the known words of a block."""
    classes = len(both)
    words_of_block = BLOCK // (2 * classes)

    def use(block: int, n: np.ndarray) -> pd.DataFrame:
        counts = n.reshape(words_of_block, 2, classes).astype(float)
        there = np.flatnonzero(counts.any(axis=(1, 2)))
        place = there + block * words_of_block
        now = np.array([shape_class[shape_of(known[p])] for p in place.tolist()], np.int64)
        return pd.DataFrame({"place": place.astype("int32"), "k": best_classes(counts[there, 0], counts[there, 1], now, both)})

    return use


def _assigned_rare(both: np.ndarray, shape_class: np.ndarray):
    """(word, c, k) from each word's neighbours (word, codes, ns)."""
    classes = len(both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 2_000):
                batch = whole.iloc[start : start + 2_000]
                codes = np.concatenate(batch["codes"].to_numpy()).astype(np.int64)
                ns = np.concatenate(batch["ns"].to_numpy()).astype(np.float64)
                row = np.repeat(np.arange(len(batch)), batch["codes"].map(len).to_numpy()) * classes
                into, out = (np.bincount(row + side, ns, len(batch) * classes).reshape(-1, classes) for side in (codes // classes, codes % classes))
                now = np.array([shape_class[shape_of(bytes(w))] for w in batch["word"]], np.int64)
                yield pd.DataFrame({"word": batch["word"].to_numpy(), "c": out.sum(axis=1).astype(np.int64), "k": best_classes(into, out, now, both)})

    return run


@dataclass
class Model:
    """Bounded tables of a fitted model; ``counts`` (word, c, k) is the distributed table of all words that are not known ones."""

    known: list[bytes]
    known_counts: np.ndarray
    class_of: np.ndarray  # of known words, then of shapes
    transitions: np.ndarray  # log10, from class to class; class 0 is the end
    emission: np.ndarray  # log10 of the denominators of words in a class
    tokens: int
    types: int
    texts: int
    counts: DataFrame


def _lexicon(training: DataFrame, clustered: int | None, classes: int, known: int) -> Model:
    """A model without transitions: counts and classes of all words of ``training``."""
    texts = training.count()
    top = word_counts(training).where(F.octet_length("word") <= KNOWN_BYTES).orderBy(F.desc("c"), "word").limit(max(known, clustered or 0)).toArrow()
    listed, listed_counts = top["word"].to_pylist(), top["c"].to_numpy().astype(np.float64)
    held = int(listed_counts.sum())
    units = listed[: clustered_of(held) if clustered is None else clustered]
    pairs = _pair_matrix(training, units, np.uint32 if held < 1 << 31 else np.float64)
    of = exchange(pairs, classes)
    after = np.stack([pairs[:, of == k].sum(axis=1, dtype=np.float64) for k in range(classes)], axis=1)
    both = np.eye(classes)[of].T @ after
    del pairs
    shape_class = of[len(units) : len(units) + SHAPES]

    # classes as the exchange has them: words that are no units count as their shapes
    kinds = np.concatenate((of[: len(units)], [shape_class[shape_of(w)] for w in listed[len(units) :]], shape_class)).astype(np.int64)
    near = cut(_texts(training).mapInPandas(_neighbours(listed, kinds, len(units), classes), "block int, packed binary, word binary, code int"))
    counted = near.where("packed is not null").select("block", "packed")
    later = _summed(counted, BLOCK // (2 * classes) * 2 * classes, _assigned_known(listed, both, shape_class), "place int, k long").toArrow()  # one row a known word
    class_of = kinds.copy()
    class_of[later["place"].to_numpy()] = later["k"].to_numpy()
    # by word once: the sums and the lists need no other exchange
    rare = near.where("word is not null").select("word", "code", "block").repartition("word")
    rare = rare.groupBy("word", "code").agg(F.sum(-F.col("block").cast("long")).alias("n")).groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("x"))
    counts = cut(rare.select("word", F.col("x.code").alias("codes"), F.col("x.n").alias("ns")).mapInPandas(_assigned_rare(both, shape_class), "word binary, c long, k long"))
    mass = np.zeros((classes, 2))
    np.add.at(mass, class_of[: len(listed)], np.stack((listed_counts, np.ones(len(listed))), axis=1))
    total, types = held, len(listed)
    for row in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[row["k"]] += row["c"], row["v"]
        total, types = total + row["c"], types + row["v"]
    emission = np.log10(mass.sum(axis=1) + 1)
    emission[0] = 0.0
    return Model(listed, listed_counts, class_of, np.zeros((classes, classes)), emission, total + texts, types + (texts > 0), texts, counts)


def _transitions(tags: DataFrame, classes: int) -> np.ndarray:
    """log10 of the smoothed class transitions, counted over the tagged texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for copies, kinds in zip(batch["copies"], batch["kinds"], strict=True):
                row = np.concatenate(([0], np.frombuffer(kinds, np.uint8), [0]))
                sums += np.bincount(row[:-1] * classes + row[1:], minlength=classes * classes) * int(copies)
        yield pd.DataFrame({"pair": np.flatnonzero(sums), "n": sums[sums > 0]})

    between = np.zeros(classes * classes)
    for row in tags.select("copies", "kinds").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        between[row["pair"]] = row["n"]
    between = between.reshape(classes, classes)
    arrivals = between.sum(axis=0)
    unigram = (arrivals + 1) / (arrivals.sum() + classes)
    return np.log10((between + PRIOR * unigram) / (between.sum(axis=1, keepdims=True) + PRIOR))


def fit(training: DataFrame, clustered: int | None = None, classes: int = CLASSES, known: int = KNOWN) -> Model:
    """Fits the model on all ``training`` texts (column text; null counts as empty)."""
    model = _lexicon(training, clustered, classes, known)
    rows = training.select(F.lit(0).alias("doc_id"), "text")
    model.transitions = _transitions(_tagged(rows, model), classes)
    return model


def _look_up(model: Model):
    """A row for each text, and one for each place of a word whose count and class no executor holds."""
    known, known_counts, class_of, texts = model.known, model.known_counts, model.class_of, model.texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, n = _Ids(known, len(known)), len(known)
        logs = np.concatenate((np.log10(known_counts + 1), np.zeros(SHAPES)))
        for batch in batches:
            whole: list[tuple] = []
            rare: list[bytes] = []
            at: list[np.ndarray] = []
            of: list[int] = []
            start = 0
            for k, text in enumerate(batch["text"]):
                words = words_of(text)
                row = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                inside = int((row < n).sum()) + (texts > 0)
                whole.append((inside, float(logs[row].sum()), class_of[row].astype(np.uint8).tobytes()))
                some = np.flatnonzero(row >= n)
                at.append(some)
                of.append(len(some))
                rare += [words[j] for j in some.tolist()]
                if len(rare) > 100_000 or k + 1 == len(batch):
                    yield _rows(batch.iloc[start : k + 1], whole, rare, np.concatenate(at), of)
                    whole, rare, at, of, start = [], [], [], [], k + 1

    return run


def _rows(batch: pd.DataFrame, whole: list[tuple], rare: list[bytes], at: np.ndarray, of: list[int]) -> pd.DataFrame:
    """Rows of texts, with a word that no text can hold, different for each, and of their rare words."""
    ids, keys = batch["doc_id"].astype("Int64").reset_index(drop=True), batch["key"].to_numpy()
    inside, seen, kinds = zip(*whole, strict=True)
    place = np.repeat(np.arange(len(whole)), of)
    none = [None] * len(rare)
    zero = np.zeros(len(rare), np.int64)
    return pd.DataFrame({
        "doc_id": pd.concat((ids, ids.iloc[place]), ignore_index=True), "key": np.concatenate((keys, keys[place])),
        "copies": np.concatenate((np.ones(len(whole), np.int64), zero)), "n_known": np.concatenate((np.array(inside, np.int64), zero)),
        "seen": np.concatenate((np.array(seen, float), zero.astype(float))), "kinds": [*kinds, *none],
        "word": [*(f" {i}:{k}".encode() for i, k in zip(ids, keys, strict=True)), *rare], "at": pd.array([*[pd.NA] * len(whole), *at.tolist()], dtype="Int64"),
    })


@F.pandas_udf(T.BinaryType())
def _filled(kinds: pd.Series, places: pd.Series) -> pd.Series:
    """Classes of a text's words, with those of the words that were joined (place times 256, and class)."""
    out = []
    for row, some in zip(kinds, places, strict=True):
        if len(some):
            whole, some = np.frombuffer(row, np.uint8).copy(), np.asarray(some, np.int64)
            whole[some >> 8] = some & 255
            row = whole.tobytes()
        out.append(bytes(row))
    return pd.Series(out, dtype=object)


def _tagged(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, copies, n_known, seen (sum of log10 of counts and one) and kinds (a byte a word) of each different row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInPandas(_look_up(model), "doc_id long, key long, copies long, n_known long, seen double, kinds binary, word binary, at long")
    counts = model.counts.select(F.col("word").alias("w"), "c", "k")
    # rows that stand for a text have a word that no text can hold, different for each
    joined = parts.join(counts.hint("merge"), F.col("word") == F.col("w"), "left")
    place = F.when(F.col("c").isNotNull(), F.col("at") * 256 + F.col("k"))
    sums = joined.groupBy("doc_id", "key").agg(
        F.sum("copies").alias("copies"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("seen") + F.coalesce(F.log10(F.col("c") + 1.0), F.lit(0.0))).alias("seen"),
        F.max("kinds").alias("kinds"), F.collect_set(place).alias("places"),
    )
    return sums.select("doc_id", "copies", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), (F.col("seen") / F.col("copies")).alias("seen"), _filled("kinds", "places").alias("kinds"))


def _scored(tags: DataFrame, model: Model) -> DataFrame:
    transitions, emission = model.transitions, model.emission
    denominator, end = float(np.log10(model.tokens + model.types + 1)), float(np.log10(model.texts + 1))

    @F.pandas_udf("double")
    def of_classes(column: pd.Series) -> pd.Series:
        out = []
        for kinds in column:
            row = np.concatenate(([0], np.frombuffer(kinds, np.uint8), [0]))
            out.append(float(transitions[row[:-1], row[1:]].sum() - emission[row].sum()))
        return pd.Series(out, dtype="float64")

    each = tags.withColumn("score", of_classes("kinds") + F.col("seen")).withColumn("n_tokens", F.octet_length("kinds").cast("long") + 1).drop("kinds")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id", _is_held("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("seen") + end - denominator * F.col("n_tokens")).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _is_held(doc_id: str) -> Column:
    return fold(F.col(doc_id), HELD_OUT_FOLD) == HELD_OUT


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``docs``.

    A null text is empty and scores as the end alone. Repeated rows are counted as often as they
    stand there and each get a row. A null doc_id counts as empty text for the fold. A word that no
    training text has is scored as the one unknown word of its shape's class. Other columns are
    ignored; without training texts every base score is 0. No rows give no rows.
    """
    return _scored(_tagged(docs, model), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``score`` of all documents with the ``fit`` of those not held out; their words are joined only once."""
    docs = table(spark, sf_dir, "documents")
    model = _lexicon(docs.where(~_is_held("doc_id")), None, CLASSES, KNOWN)
    tags = cut(_tagged(docs, model))
    model.transitions = _transitions(tags.where(~_is_held("doc_id")), CLASSES)
    return _scored(tags, model)
