"""Spelling variants, vector codes and quality rules against brute force and SQL, and on odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import codes, quality, variants
from tests.llm.test_operators import SCHEMA, odd_docs
from tests.oracle import agree, connect

# --- 11: spelling variants ------------------------------------------------------------------------------


def plain_variants(rows):
    """Contract by brute force, every word against every other by its deletions and wildcards."""
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counted[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 7 and n >= 2}
    near, wild = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
            wild[w[:k], w[k + 1 :]].append(w)
    for alike in wild.values():
        for w in alike:
            near[w].update(x for x in alike if x != w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found_variants(docs, most=variants.MOST):
    rows = variants.spelling_variants(docs, most).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("most", [variants.MOST, 12])
def test_variants_are_those_of_brute_force(spark, sf_dir, most):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found_variants(docs, most) == expected
    assert any(v[0] for v in expected.values())


@pytest.mark.parametrize("most", [variants.MOST, 8])
def test_variants_of_alike_words_and_chains(spark, most):
    random.seed(11)
    words = {"aaaaaaa" + "".join(random.choice("ab") for _ in range(random.randrange(6))) for _ in range(150)}
    words |= {"".join(random.choice("ab") for _ in range(random.randrange(3))) + "zzzzzzzz" for _ in range(20)}
    words |= {"straßenbahn", "strassenbahn", "straßenbahm", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499}
    lines = [(k, w) for k, w in enumerate(sorted(words)) for _ in range(3)]
    # a chain of forms: 3 times, 40 times, 500 times
    lines += [(9001, " ".join(["knirschel"] * 3)), (9002, " ".join(["knirschen"] * 40)), (9003, " ".join(["knirschend"] * 500))]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    expected = plain_variants(lines)
    assert found_variants(docs, most) == expected
    assert expected["knirschel"][1] == "knirschend"


def test_near_in_trie_is_distance_one():
    random.seed(5)
    rests = sorted({"".join(random.choice("abc") for _ in range(random.randrange(6))) for _ in range(120)})

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    expected = {(i, j) for i, a in enumerate(rests) for j, b in enumerate(rests) if near(a, b)}
    got = list(variants.near_in_trie(rests))
    assert len(got) == len(set(got)) and set(got) == expected


def test_variants_of_odd_rows(spark):
    docs = odd_docs(spark, ["Äpfel ÄPFELKUCHEN äpfelkuchen Äpfelkuchen apfelkuchen", "straße×straße÷straßen " * 50])
    assert found_variants(docs) == plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found_variants(spark.createDataFrame([], SCHEMA)) == {}
    assert found_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == {}


# --- 12: vector codes -----------------------------------------------------------------------------------


def plain_codes(rows, rounds=codes.ROUNDS):
    """Contract by full scans, for (vec_id, vector) already usable and in the order of ids."""
    x = np.floor(np.array([v for _, v in rows], np.float64) * 4096).astype(np.int64).reshape(len(rows), 8, -1)
    books = x[:16].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(8):
            for e in range(books.shape[1]):
                mine = x[at[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    at, d = nearest()
    return [bytes(row.tolist()).hex() for row in at], d.sum(1).tolist(), books


@pytest.mark.parametrize("grid", [None, 2])
@pytest.mark.parametrize("groups", [1, 4, 16])
def test_codes_are_those_of_full_scans(spark, grid, groups):
    rng = np.random.default_rng(12)
    # coarse grids make ties between entries, and equal entries
    v = rng.normal(size=(300, 16)) if grid is None else rng.integers(0, grid, (300, 16)) / 4096
    rows = [(k, [float(c) for c in row], k % 3) for k, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    coded, books = codes.compress(df, groups=groups)
    code, error, expected = plain_codes([r[:2] for r in rows])
    got = coded.orderBy("vec_id").collect()
    assert [r["code"] for r in got] == code
    assert [r["error"] for r in got] == error
    assert (books.entries == expected).all()


def test_codes_spare_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 16)) * 4
    rows = [(k, [float(c) for c in centres[k % 16] + rng.normal(size=16) * 0.01], 0) for k in range(800)]
    coded, _ = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    taken = coded.agg(F.sum("taken")).first()[0]
    assert taken < 0.35 * 800 * codes.PARTS * codes.ENTRIES * (codes.ROUNDS + 1)


def test_codes_of_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [[float((k * 7 + c * 3) % 11) / 8 - 0.6 for c in range(8)] for k in range(20)]
    rows = [(k, v, [None, 1, 2][k % 3], "x", 5) for k, v in enumerate(good)]
    rows += [(100, None, 1, "x", 5), (101, [nan] + good[0][1:], 1, "x", 5), (102, [None] + good[0][1:], 1, "x", 5), (103, [inf] + good[0][1:], 1, "x", 5)]
    rows += [(3, good[3], 0, "x", 5), (3, good[3], 0, "x", 5), (3, good[4], 0, "x", 5), (None, good[5], None, "x", 5), (50, [0.0] * 8, 2, "x", 5)]
    schema = "vec_id long, embedding array<float>, label int, code string, error int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = codes.query(spark, str(tmp_path))
    assert df.count() == len(rows) - 4
    agree(df, codes.ORACLE_SQL, connect(str(tmp_path)))
    few = spark.createDataFrame(rows[:5], schema)
    coded, books = codes.compress(few)
    assert books.entries.shape == (8, 5, 1) and coded.agg(F.sum("error")).first()[0] == 0
    assert codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1, "", 1)], schema))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, "", 1)], schema))


def test_codes_agree_with_sql(spark, sf_dir):
    agree(codes.query(spark, sf_dir), codes.ORACLE_SQL, connect(sf_dir))


# --- 13: quality rules ----------------------------------------------------------------------------------


def test_quality_agrees_with_sql(spark, sf_dir):
    agree(quality.query(spark, sf_dir), quality.ORACLE_SQL, connect(sf_dir))


def test_quality_of_odd_rows(spark, tmp_path):
    extra = ["a b c d e a b c d e a", "a a a a a a", "one\n\none\none \n \n", "\x0bx\x0cy\x1cz w", "• a\n- b\n...\nc…\n" * 6, "word\n" * 400, "#*$%&|<>!!"]
    docs = odd_docs(spark, extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    agree(quality.query(spark, str(tmp_path)), quality.ORACLE_SQL, connect(str(tmp_path)))
    nothing = {r["doc_id"]: r for r in quality.verdicts(docs).where("doc_id < 3").collect()}
    assert all(nothing[k]["n_words"] == 0 and nothing[k]["base_failed"] and not nothing[k]["kept"] for k in range(3))
    assert quality.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_words_are_those_of_brute_force(spark):
    random.seed(13)
    texts = [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(80)]

    def plain(text):
        words = text.split()
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        return len({k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)})

    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_quality_keeps_good_and_drops_bad(spark, sf_dir):
    good = "the house of a friend and the way in to it is that long for all who walk there with us every day of the year"
    bad = {1: good.upper().replace(" ", "!! "), 2: good.replace(" ", "### "), 3: good.replace(" ", " | "), 4: "zig zag zog zug zeg xyz vwu rst qpo nml kji hgf edc bab cad ab cd ef gh ij kl mn op qr st uv wx yz"}
    docs = spark.createDataFrame([(0, good), *bad.items(), (5, " ".join(w for x in good.split() for w in (x, x)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["failed_rules"]) for r in quality.verdicts(docs).collect()}
    assert got[0] == (True, "")
    assert {k: v[1] for k, v in got.items() if k} == {1: "exclamations", 2: "symbols,stop_words", 3: "symbols", 4: "stop_words", 5: "doubled_words"}
    strict = [quality.Rule("long", "n_words", "n_lines", high=1000)]
    assert not any(r["kept"] for r in quality.verdicts(docs, strict).collect())


def test_a_filter_on_verdicts_is_cheap(spark):
    # the counts must not be made again inside the filter's lambdas, which would take a square of the words
    long = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60_000))) for k in range(2)], "doc_id long, text string")
    plan = quality.verdicts(long).where("not kept and not base_failed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    assert quality.verdicts(long).where("not kept and not base_failed").count() == 2  # no stop word
