"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

The automaton reads a text once; at each position its output links name the pieces that end
there, and the best of them is kept. For a unigram model best is the largest sum of scores. A BPE
model has no such sum: there the piece that ends a prefix is the one that the byte-pair merges of
that prefix would end with. Exactly one of the pieces at a position is compatible with the piece
kept at its start (the merges of the two together leave both whole), so the same relaxation finds
it, in one pass and without merging.

Texts are read in units that no piece crosses, space marks with the letters or the other characters
after them; a worker remembers the units it has met, up to a bound. Characters without a piece fall back to byte
pieces. The model's path is a parameter; its pieces, not the file, go to the executors.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units and pairs of pieces that one worker remembers at most.
REMEMBERED = 200_000
#: Texts that are in work at a time.
SLICE = 256
_WHOLE = re.compile(" *[^ ]+| +")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Recent(dict):
    """A dict that forgets what was not asked for lately: at most ``most`` keys in two halves."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.older = most // 2, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Codec:
    """Encodes and decodes by the pieces of one model; built once a process."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, dummy_prefix: bool = True, unknown: int = 0, reserved: frozenset[int] = frozenset()):
        self.state = (pieces, scores, kind, dummy_prefix, unknown, reserved)
        self.pieces, self.scores, self.kind, self.dummy, self.unknown = pieces, scores, kind, dummy_prefix, unknown
        self.byte = {}
        self.raw = []
        for k, piece in enumerate(pieces):
            found = _BYTE.fullmatch(piece)
            if found:
                self.byte[int(found[1], 16)] = k
            self.raw.append(bytes([int(found[1], 16)]) if found else b"" if k in reserved else piece.replace(SPACE, " ").encode())
        plain = {piece: k for k, piece in enumerate(pieces) if k not in reserved and not _BYTE.fullmatch(piece)}
        self.rank = {piece: scores[k] for piece, k in plain.items()}
        self.id = plain
        self.fits = Recent(REMEMBERED)
        self.met = Recent(REMEMBERED)
        self.low = min(scores, default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        # of each piece its place in the order of merging, and the two that its last merge joins
        places = {k: at for at, k in enumerate(sorted(plain.values(), key=lambda k: -scores[k]), start=1)}
        self.place, self.halves = {}, {}
        for piece, k in plain.items():
            # a piece that its own merges do not lead to can't come out of any text
            if kind != "bpe" or len(piece) == 1 or self.merged(piece) == [k]:
                self.automaton.add_word(piece, (k, len(piece)))
                self.place[k] = 0 if len(piece) == 1 else places[k]
        if kind == "bpe":
            for k in self.place:
                if len(pieces[k]) > 1:
                    self.halves[k] = self._last_merge(pieces[k])
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in pieces]
        self.unit = self._unit_pattern([pieces[k] for k in self.place])

    @staticmethod
    def _unit_pattern(pieces: list[str]) -> re.Pattern:
        """Units that no piece crosses: blanks with the letters, or with the other characters, after them.

        Where some piece has letters and others side by side, units end at blanks alone.
        """
        odd = "".join(sorted({c for p in pieces for c in p if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()}))
        letters, others = rf"[^\W\d_{odd}]+", rf"(?:[^\w ]|[\d_{odd}])+"
        one = re.compile(f"{letters}|{others}|")
        if all(one.fullmatch(p.lstrip(SPACE)) and SPACE not in p.lstrip(SPACE) for p in pieces):
            return re.compile(f" *(?:{letters}|{others})| +")
        return _WHOLE

    def __reduce__(self):
        return (codec_of, tuple(tuple(x) if isinstance(x, list) else x for x in self.state))

    def merged(self, text: str, upto: int = 0) -> list[int]:
        """Byte-pair merges in order of score, leftmost first: the definition, for short or rare units.

        With ``upto`` the merges stop before the one that would leave so few pieces.
        """
        size = len(text)
        after, before, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
        alive, count = [True] * size, size
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < size:
                score = self.rank.get(text[left : end[right]])
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, end[right]))

        for k in range(size):
            offer(k)
        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if not alive[left] or not alive[right] or after[left] != right or end[right] != stop:
                continue
            count -= 1
            if count == upto:
                break
            end[left], alive[right], after[left] = stop, False, after[right]
            if after[left] < size:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        out: list[int] = []
        at = 0
        while at < size:
            piece = text[at : end[at]]
            out += [self.id[piece]] if piece in self.id else self._bytes(piece)
            at = after[at]
        return out

    def _bytes(self, piece: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def _last_merge(self, piece: str) -> tuple[int, int]:
        """The pieces that stand side by side before a piece's last merge."""
        apart = self.merged(piece, upto=1)
        return apart[0], apart[1]

    def _compatible(self, one: int, two: int) -> bool:
        """Whether the merges of the two pieces' texts together leave both whole.

        They don't if, at some time, what stands at the border on either side makes a piece before
        either side's next merge. So both sides are taken apart, the later merge first.
        """
        key = one << 24 | two
        found = self.fits.older.get(key)
        if found is None:
            found = self._stay_apart(one, two)
        self.fits.keep(key, found)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        pieces, ids, place, halves = self.pieces, self.id, self.place, self.halves
        # a merge at the border happens if it comes before the merge that consumes a side
        ends_left = ends_right = 1 << 60
        while True:
            joined = ids.get(pieces[left] + pieces[right])
            if joined is not None:
                # at the same place in the order the leftmost goes first
                at = place.get(joined, 1 << 59)
                if at < ends_left and at <= ends_right:
                    return False
            a, b = place[left], place[right]
            if not a and not b:
                return True
            if a > b:
                ends_left, left = a, halves[left][1]
            else:
                ends_right, right = b, halves[right][0]

    def fitted(self, unit: str) -> list[int]:
        """The pass for BPE models: at each position the one piece that is compatible with the piece before it."""
        size = len(unit)
        last = [-1] * (size + 1)
        last[0] = -2
        known = self.fits.get
        for end, (piece, length) in self.automaton.iter(unit):
            stop = end + 1
            if last[stop] == -1:
                left = last[stop - length]
                if left == -1:  # after a character without a piece
                    return self.relaxed(unit)
                ok = left == -2 or known(left << 24 | piece)
                if ok is None:
                    ok = self._compatible(left, piece)
                if ok:
                    last[stop] = piece
        out: list[int] = []
        while size:
            piece = last[size]
            if piece < 0:
                return self.relaxed(unit)
            out.append(piece)
            size -= self.sizes[piece]
        out.reverse()
        return out

    def relaxed(self, unit: str) -> list[int]:
        """One pass over the automaton's matches, keeping the best last piece at each position."""
        size = len(unit)
        last = [-1] * (size + 1)  # the piece that ends a prefix; -2 stands for bytes
        start_of = [0] * (size + 1)
        best = [float("-inf")] * (size + 1)
        best[0] = 0.0
        reached, bpe = 0, self.kind == "bpe"
        fits = self.fits
        low = self.low

        def bridge(upto: int) -> int:
            """Positions that no piece ends at: the character before goes out as bytes."""
            at = reached + 1
            while at <= upto:
                if last[at] == -1:
                    last[at], start_of[at], best[at] = -2, at - 1, best[at - 1] + low
                at += 1
            return max(reached, upto)

        last[0] = -2
        for end, (piece, length) in self.automaton.iter(unit):
            stop = end + 1
            if bpe and last[stop] != -1:
                continue
            if reached < end:
                reached = bridge(end)
            start = stop - length
            if bpe:
                left = last[start]
                ok = left == -2 or fits.get(left << 24 | piece)
                if ok is None:
                    ok = self._compatible(left, piece)
                if ok:
                    last[stop], start_of[stop], reached = piece, start, stop
            elif best[start] + self.scores[piece] > best[stop]:
                last[stop], start_of[stop], best[stop] = piece, start, best[start] + self.scores[piece]
        bridge(size)
        out: list[int] = []
        at = size
        while at:
            out += [last[at]] if last[at] >= 0 else self._bytes(unit[start_of[at] : at])[::-1]
            at = start_of[at]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for null or empty text."""
        return self.encode_checked(text)[0]

    def encode_checked(self, text: str | None) -> tuple[np.ndarray, bool]:
        """The ids, and whether they decode to the text.

        Ids are decoded piece by piece, so a text comes back if each of its units does, which is
        tried when a unit is encoded.
        """
        if not text:
            return np.zeros(0, np.int32), True
        plain = text.replace(SPACE, " ")
        exact = plain == text
        plain = " " + plain if self.dummy else plain
        out: list[int] = []
        met = self.met
        for unit in self.unit.findall(plain):
            found = met.get(unit)
            if found is None:
                found = met.older.get(unit)
                if found is None:
                    found = self._unit_ids(unit)
                if len(unit) <= 64:
                    met.keep(unit, found)
            if not found[1]:
                exact = False
            out += found[0]
        return np.array(out, np.int32), exact

    def _unit_ids(self, unit: str) -> tuple[tuple[int, ...], bool]:
        """The ids of a unit, and whether they decode to it.

        Runs of two blanks or more are merged by the definition: which of their pieces stand side by
        side depends on how long the run is, not only on the pieces at a border.
        """
        marked = unit.replace(" ", SPACE)
        if self.kind != "bpe":
            ids = self.relaxed(marked)
        else:
            ids = self.merged(marked) if marked.startswith(SPACE * 2) else self.fitted(marked)
        return tuple(ids), b"".join(map(self.raw.__getitem__, ids)) == unit.encode("utf-8", "surrogatepass")

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec_of(pieces: tuple, scores: tuple, kind: str, dummy: bool, unknown: int, reserved: frozenset) -> Codec:
    return Codec(list(pieces), list(scores), kind, dummy, unknown, reserved)


def load(path: str = MODEL_PATH, kind: str = "bpe") -> Codec:
    """The codec of a model file; kind is "bpe" or "unigram", as the model was trained."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    reserved = frozenset(k for k in every if model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
    return codec_of(tuple(model.id_to_piece(k) for k in every), tuple(model.get_score(k) for k in every), kind, True, model.unk_id(), reserved)


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """Adds n_tokens, ids and exact to all columns of ``docs``, for the whole of column text.

    exact says that decoding the ids gives the text back; it fails only for texts that hold the
    space mark itself, which decodes to a space. Null and empty texts have no ids and are exact.
    Columns of ``docs`` that have one of the three names are replaced. No rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "exact")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).select(kept)
                texts = batch.slice(at, SLICE).column("text").to_pylist()
                done = [codec.encode_checked(t) for t in texts]
                ids, exact = [x for x, _ in done], [e for _, e in done]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), lists, pa.array(exact, pa.bool_())], names=[*kept, "n_tokens", "ids", "exact"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *added]))


def decode(coded: DataFrame, codec: Codec, column: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids; null ids give null, no ids the empty text."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec.decode(x.tolist()) for x in rows], dtype=object)

    return coded.withColumn("decoded", F.pandas_udf(run, "string")(coded[column]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), load()).select("doc_id", "n_tokens", "ids", "exact")
