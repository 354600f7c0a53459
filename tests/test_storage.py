"""What is stored and read again, two engines, timings, and an embedding job that survives."""

from __future__ import annotations

import io
import json
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.functions import text
from cotejo.operators import embed, retrieve, shadow, stored
from cotejo.operators.timing import Timings
from cotejo.plans import retrieval_queries as r
from cotejo.plans.search import SearchConfig, search
from cotejo.sources import relational, versions, workbook

# --- the stored index -----------------------------------------------------------------------------


def corpus_of(spark, count=400):
    random.seed(2)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    # long texts of frequent words, and short ones that hold rare words often
    rows = [(k, " ".join(random.choices(words, weights, k=random.choice([5, 8, 40, 300])))) for k in range(count)]
    return spark.createDataFrame([*rows, (count, None), (count + 1, "")], "doc_id long, text string")


def test_counted_terms_are_those_of_a_counter(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b", ""]), (2, []), (3, None), (4, ["x"])], "k int, tokens array<string>")
    got = {x["k"]: {e["term"]: e["tf"] for e in x["c"] or []} for x in rows.select("k", text.counted(F.col("tokens")).alias("c")).collect()}
    assert got == {1: {"a": 1, "b": 3, "": 1}, 2: {}, 3: {}, 4: {"x": 1}}


@pytest.mark.parametrize("listed", [stored.LISTED, 1])
def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(stored, "LISTED", listed)
    corpus = corpus_of(spark)
    queries = spark.createDataFrame([(1, "w0 w5"), (2, "w59 w58 w58"), (3, "w3"), (4, "nothing of it"), (5, ""), (6, "w0 w1 w2 w3 w4 w40")], "query_id int, query string")
    index = stored.build_bm25(corpus, str(tmp_path / "i"), buckets=8, segment=16)
    expected = sorted(map(tuple, retrieve.top_k(retrieve.bm25(corpus, queries), 7).collect()))
    assert sorted(map(tuple, stored.bm25_top(index, queries, 7).collect())) == expected and expected
    words = stored.build_tfidf(corpus, str(tmp_path / "t"), text.word_ngrams, "words", buckets=8, segment=16)
    for least in (0.0, 0.3):
        expected = sorted(map(tuple, retrieve.tfidf_top(corpus, queries, text.word_ngrams, 7, least).collect()))
        assert sorted(map(tuple, stored.tfidf_top(words, queries, text.word_ngrams, 7, least).collect())) == expected
    variants = spark.createDataFrame([(1, 1, "w0 w5", 1.0), (1, 2, "w59", 0.6), (2, 1, "w7", 1.0)], "query_id int, ord int, query string, weight double")
    expected = sorted(map(tuple, retrieve.bm25_variants(corpus, variants, 20, 9).collect()))
    assert sorted(map(tuple, stored.bm25_variants(index, variants, 20, 9).collect())) == expected


def test_index_reads_little(spark, tmp_path):
    corpus = corpus_of(spark, 1500)
    index = stored.build_bm25(corpus, str(tmp_path / "i"), buckets=8, segment=16)
    queries = spark.createDataFrame([(1, "w0"), (2, "w30 w2")], "query_id int, query string")
    found = stored.search(index, stored.asked_bm25(index, queries), 3)
    opened = {x["query_id"]: (x["opened"], x["segments"]) for x in found.opened.collect()}
    assert opened[1][0] < 0.4 * opened[1][1] and opened[2][0] < 0.6 * opened[2][1]
    # only the terms' buckets are listed, and the term reaches the scan
    asked = spark.createDataFrame([("w30",)], "term string")
    plan = stored._of_terms(index.blocks, asked, 8).select("most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,w30)" in plan and "doc_ids" not in plan


def test_index_is_checked_when_loaded(spark, tmp_path):
    corpus, path = corpus_of(spark, 40), str(tmp_path / "i")
    assert stored.load(spark, path) is None
    index = stored.build_bm25(corpus, path, buckets=4)
    assert stored.load(spark, path).meta["n"] == 42 and not stored.is_stale(index, corpus) and stored.is_stale(index, corpus.limit(3))
    index.docs.limit(5).write.parquet(str(tmp_path / "less"))
    spark.read.parquet(str(tmp_path / "less")).write.mode("overwrite").parquet(f"{path}/docs")
    assert stored.load(spark, path) is None and stored.load(spark, path, verify=False) is not None
    manifest = spark.read.json(f"{path}/manifest").withColumn("version", F.lit(1))
    spark.createDataFrame(manifest.collect(), manifest.schema).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    assert stored.load(spark, path, verify=False) is None


def test_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    index = stored.build_bm25(empty, str(tmp_path / "i"))
    assert stored.bm25_top(index, spark.createDataFrame([(1, "a b")], "query_id int, query string"), 3).count() == 0


def test_search_with_an_index_gives_the_same(spark, sf_dir, tmp_path):
    corpus, queries = r.parts(spark, sf_dir), r.part_queries(spark)
    index = stored.build_bm25(corpus, str(tmp_path / "i"), segment=32)
    timings = Timings()
    rows = lambda config: sorted(map(tuple, search(corpus, queries, config).collect()))
    began = time.perf_counter()
    got = rows(SearchConfig(index=index, timings=timings))
    wall = (time.perf_counter() - began) * 1000
    assert got == rows(SearchConfig()) and got
    steps = {x["label"]: x for x in timings.table(spark).collect()}
    assert list(steps) == ["correct", "rewrite", "retrieve", "rank", "confidence"]
    assert sum(x["ms"] for x in steps.values()) < wall and steps["correct"]["rows"] == len(r.PART_QUERIES) and steps["confidence"]["rows"] == len(got)


def test_a_candidate_without_document_has_its_id_as_text(spark):
    from cotejo.plans.search import hydrate

    corpus = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    found = spark.createDataFrame([(7, 1, 0.5), (7, 9, 0.4), (8, 1, 0.3)], "query_id int, doc_id long, score double")
    got = {(x["query_id"], x["doc_id"]): (x["text"], x["score"]) for x in hydrate(found, corpus).collect()}
    assert got == {(7, 1): ("one", 0.5), (7, 9): ("9", 0.4), (8, 1): ("one", 0.3)}


def test_cross_scores_of_a_provider(spark):
    from cotejo.operators import rerank

    class Lengths:
        def score(self, pairs):
            if any(text == "bad" for _, text in pairs):
                raise RuntimeError("down")
            return [None if not text else float(len(query) + len(text)) for query, text in pairs]

    rows = spark.createDataFrame([("q", t) for t in ["a", "bad", "bcd", "", None, "abcdef"]], "query string, text string").coalesce(1)
    assert [x["cross"] for x in rerank.crossed(rows, Lengths(), batch=4).collect()] == [2.0, 0.0, 4.0, 0.0, 0.0, 7.0]


def test_products_without_text_get_no_number(spark):
    from cotejo.operators import aggregate

    rows = spark.createDataFrame([(3, "a", "A"), (1, " ", "B"), (2, "c", None), (5, "d", "D")], "first_row long, text string, semantic_text string")
    assert {x["text"]: x["id"] for x in aggregate.number_documents(rows).collect()} == {"a": "DOC_00000", "d": "DOC_00001"}


@pytest.mark.parametrize("most", [100_000, 20, 3])
def test_medians_do_not_depend_on_how_values_are_cut(spark, most):
    import statistics

    from cotejo.operators import aggregate

    random.seed(9)
    rows = [(key, random.choice([round(random.gauss(100, 10), 3), 7.0, float(random.randrange(300))])) for key, n in (("a", 900), ("b", 701), ("c", 4), (None, 300)) for _ in range(n)]
    expected = {k: statistics.median([v for key, v in rows if key == k]) for k in ("a", "b", "c", None)}
    df = spark.createDataFrame([*rows, ("d", None)], "k string, value double")
    assert {x["k"]: x["median"] for x in aggregate.medians(df, "k", most=most).collect()} == expected


def test_wide_rows_are_not_broadcast(spark):
    from cotejo.operators.index import small

    rows = spark.createDataFrame([(1, "x" * 1000, [1.0, 2.0]), (2, None, None)], "k long, text string, v array<double>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(rows)) and hinted(small(rows.limit(0))) and not hinted(small(rows, chars=500)) and not hinted(small(rows, most=1))


def test_every_text_of_the_embedding_query_has_its_vector(spark, sf_dir):
    from cotejo.plans import catalog

    rows = catalog.queries()["embedding_job"](spark, sf_dir).collect()
    assert len(rows) == r.parts(spark, sf_dir).count()
    for x in rows:
        assert x["embedding"] == pytest.approx(embed.StandIn(16).embed([x["text"]])[0].tolist(), abs=1e-9)


def test_timings_ignore_what_was_not_started(spark):
    timings = Timings()
    timings.end("never")
    timings.start("a")
    timings.end("a")
    timings.end("a")
    assert [x["label"] for x in timings.table(spark).collect()] == ["a"]
    timings.reset()
    assert timings.table(spark).count() == 0


# --- two engines ----------------------------------------------------------------------------------


def engine(factor, fail=False):
    def run(queries):
        if fail:
            raise RuntimeError("engine is down")
        return queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).select("query_id", (F.col("rank") * factor).alias("doc_id"), "rank", (1.0 / F.col("rank")).alias("score"))

    return run


def test_shadow_compares_a_share_and_survives(spark):
    queries = spark.createDataFrame([(k, f"query {k}") for k in range(200)], "query_id int, query string")
    told = []
    answer = shadow.shadow(queries, engine(1), engine(2), 0.25, lambda rows: told.append(rows.count()))
    assert answer.result.count() == 800 and answer.error is None
    compared = answer.comparison.collect()
    assert 25 < len(compared) < 75 and answer.metrics["compared"] == len(compared) == answer.metrics["differing"] == told[0]
    assert all(x["jaccard"] == pytest.approx(2 / 6) and not x["agrees"] for x in compared)
    assert {x["query_id"] for x in compared} == {x["query_id"] for x in shadow.shadow(queries, engine(1), engine(1), 0.25).comparison.collect()}
    assert shadow.shadow(queries, engine(1), engine(2), 0.0).metrics["compared"] == 0
    assert shadow.shadow(queries, engine(1), engine(1), 1.0).metrics == {"compared": 200, "differing": 0, "mean_jaccard": 1.0, "most_score_error": 0.0}
    with pytest.warns(UserWarning, match="engine is down"):
        broken = shadow.shadow(queries, engine(1), engine(1, fail=True), 1.0)
    assert broken.result.count() == 800 and broken.comparison is None and broken.error is not None


# --- dense search -----------------------------------------------------------------------------------


def test_dense_grid_is_one_plan_without_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = vectors.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, retrieve.dense_top(vectors, queries, 5, 4).collect()))
    for name, value in (("MOST_QUERIES", 40), ("CELL_VECTORS", 50), ("SLICE", 16)):
        monkeypatch.setattr(retrieve, name, value)
    grid = retrieve.dense_top(vectors, queries, 5, 4)
    assert sorted(map(tuple, grid.collect())) == whole and len(whole) == 1500
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "Union" not in plan


# --- the relational store -------------------------------------------------------------------------


def test_store_upserts_at_once_and_reads_in_parts(spark):
    store = relational.Store.embedded(spark)
    store.create(spark)
    store.create(spark)
    assert set(relational.ENTITIES) <= store.tables(spark)
    rows = lambda *pairs: spark.createDataFrame([(u, d) for u, d in pairs], "user_id string, data string")
    store.upsert(rows(("a", "1"), ("b", "1"), ("c", "1")), "user_preferences")
    store.upsert(rows(("b", "2"), ("d", "2")), "user_preferences")
    got = {x["user_id"]: x["data"] for x in store.read(spark, "user_preferences").collect()}
    assert got == {"a": "1", "b": "2", "c": "1", "d": "2"}
    with pytest.raises(ValueError, match="twice"):
        store.upsert(rows(("a", "3"), ("a", "4"), ("e", "3")), "user_preferences")
    assert {x["user_id"]: x["data"] for x in store.read(spark, "user_preferences").collect()} == got
    assert not [t for t in store.tables(spark) if t.startswith("stage")]
    with pytest.raises(ValueError, match="no key"):
        store.upsert(rows(("a", "1")), "favorites")
    history = spark.range(100).select(F.col("id").cast("string").alias("user_id"), F.lit("mop").alias("query"))
    store.append(history, "search_history")
    read = store.read(spark, "search_history", by="id", partitions=4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100 and read.first()["results_count"] == 0
    plan = read.where("user_id = '7'").select("query")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(USER_ID), *EqualTo(USER_ID,7)]" in plan
    assert store.read(spark, "favorites", by="id").count() == 0


def test_store_rolls_a_failed_transaction_back(spark):
    store = relational.Store.embedded(spark)
    store.create(spark)
    with pytest.raises(Exception, match="(?i)nowhere"):
        store.execute(spark, "INSERT INTO favorites (user_id, item_name) VALUES ('a', 'b')", "INSERT INTO nowhere VALUES (1)")
    assert store.read(spark, "favorites").count() == 0


def test_shared_store_is_like_the_database(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame([(u, d) for u, d in pairs], "user_id string, data string")
    seen = []
    for store in (relational.Store.embedded(spark), relational.Shared(spark, f"file://{tmp_path}/store")):
        store.create(spark)
        store.create(spark)
        store.upsert(rows(("a", "1"), ("b", "1"), ("c", "1")), "user_preferences")
        ids = {x["user_id"]: x["id"] for x in store.read(spark, "user_preferences").collect()}
        store.upsert(rows(("b", "2"), ("d", "2")), "user_preferences")
        with pytest.raises(ValueError, match="twice"):
            store.upsert(rows(("a", "3"), ("a", "4"), ("e", "3")), "user_preferences")
        with pytest.raises(Exception, match="(?i)null"):
            store.upsert(rows(("a", None)), "user_preferences")
        with pytest.raises(ValueError, match="no key"):
            store.upsert(rows(("a", "1")), "favorites")
        with pytest.raises(Exception, match="(?i)trunc|too long"):
            store.append(spark.createDataFrame([("x" * 300, "mop")], "user_id string, query string"), "search_history")
        for _ in range(2):
            store.append(spark.range(50).select(F.col("id").cast("string").alias("user_id"), F.lit("mop").alias("query")), "search_history")
        now = store.read(spark, "user_preferences", by="id").collect()
        assert {x["user_id"]: x["id"] for x in now if x["user_id"] in ids} == ids and len({x["id"] for x in now}) == 4
        history = store.read(spark, "search_history", by="id").collect()
        assert len({x["id"] for x in history}) == 100 and all(x["created_at"] for x in history)
        seen.append((sorted((x["user_id"], x["data"]) for x in now), sorted((x["user_id"], x["query"], x["context_tags"] or "", x["results_count"]) for x in history)))
    assert seen[0] == seen[1]


def test_an_embedded_database_needs_one_process(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    with pytest.raises(RuntimeError, match="one for each JVM"):
        relational.Store.embedded(spark)


# --- workbooks ------------------------------------------------------------------------------------


def book(path, sheets):
    with open(path, "wb") as out:
        workbook.write_workbook(out, {name: (rows[0], iter(rows[1:])) for name, rows in sheets.items()})


def test_workbooks_of_a_folder(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"Outra": [["x"], [1]], "Dados": [["nome", "valor", "marca"], ["Mop & cabo <1>", 5, None], [None, None, None], ["é\n b", 2.5, True]]})
    book(tmp_path / "b.xlsx", {"Plan1": [["valor", "nome", "nome"], ["7", "Pad", "again"]]})
    (tmp_path / "note.txt").write_text("no workbook")
    rows = workbook.read_workbooks(spark, str(tmp_path), {"nome": "name", "valor": "price", "marca": "brand", "cor": "colour"}, "Dados")
    assert rows.rdd.getNumPartitions() == 2
    got = [tuple(x) for x in rows.orderBy("row_idx").collect()]
    assert [g[1:] for g in got] == [("Mop & cabo <1>", "5", None, None), ("é\n b", "2.5", "true", None), ("Pad", "7", None, None)]
    assert got[0][0] < got[1][0] < got[2][0]
    assert spark.read.format("workbook").load(str(tmp_path / "b.xlsx")).columns == ["row_idx", "valor", "nome"]
    with pytest.raises(FileNotFoundError):
        workbook.read_workbooks(spark, str(tmp_path / "missing.xlsx"), {"a": "b"})


def test_workbook_with_shared_strings_and_gaps():
    made = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(made, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId9"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="/xl/worksheets/one.xml"/></Relationships>')
        out.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si></sst>")
        out.writestr("xl/worksheets/one.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="str"><v>far</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5" t="e"><v>#N/A</v></c><c r="AB5"><v>12.0</v></c></row></sheetData></worksheet>')
    rows = list(workbook.rows_of(io.BytesIO(made.getvalue())))
    assert rows[0][0] == "name" and rows[0][27] == "far" and len(rows) == 2
    assert rows[1][0] == "rich text" and rows[1][2] is None and rows[1][27] == "12"


def test_a_full_sheet_goes_on_in_the_next(monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 4)
    made = io.BytesIO()
    workbook.write_workbook(made, {"S": (["a"], iter([[k] for k in range(7)]))})
    with zipfile.ZipFile(made) as out:
        assert sum(n.startswith("xl/worksheets/") for n in out.namelist()) == 3
    assert [x[0] for x in workbook.rows_of(io.BytesIO(made.getvalue()))] == ["a", "0", "1", "2"]


def test_cart_as_a_workbook(spark, tmp_path):
    from cotejo.operators import state

    items = spark.createDataFrame([("Mop", 2.5, 2), ("Pad", 1.0, 1), ("None", 1.0, 0)], "name string, price double, qty int")
    workbook.write_cart(state.per_unit(items, "qty").select("name", "unit", "price"), state.cart_summary(items, "price", "qty"), str(tmp_path / "cart.xlsx"))
    with open(tmp_path / "cart.xlsx", "rb") as made:
        figures, lines = list(workbook.rows_of(made, "Resumo")), list(workbook.rows_of(made, "Itens"))
    assert dict(zip(*figures, strict=True)) == {"lines": "3", "units": "3", "value": "6", "mean_price": "2"}
    assert sorted(lines[1:]) == [["Mop", "1", "2.5"], ["Mop", "2", "2.5"], ["Pad", "1", "1"]]


# --- versions -------------------------------------------------------------------------------------


def test_versions_are_whole_and_roll_back(spark, tmp_path):
    kept = versions.Versions(spark, f"file://{tmp_path}/v")
    assert kept.current() is None and kept.names() == []
    with pytest.raises(LookupError):
        kept.read()
    first = kept.write(spark.range(10), "ten", "numbers", original_rows=12)
    reader = kept.read()
    second = kept.write(spark.range(5))
    assert reader.count() == 10 and kept.read().count() == 5 and kept.read(first).count() == 10
    envelope = kept.envelope(first)
    assert (envelope["description"], envelope["originalRows"], envelope["uniqueDocuments"], envelope["version"]) == ("ten", 12, 10, "3.0.0")
    assert envelope["corpusHash"] != kept.envelope()["corpusHash"]
    with pytest.raises(Exception, match="(?s)."):
        kept.write(spark.range(3).select(F.raise_error(F.lit("broken while writing")).alias("id")))
    assert kept.current() == second and kept.names() == [first, second]
    assert kept.rollback() == first and kept.read().count() == 10
    with pytest.raises(LookupError):
        kept.rollback()
    kept.rollback(second)
    third = kept.write(spark.range(1))
    assert kept.prune(1) == [first, second] and kept.names() == [third]
    kept.export_json(f"{tmp_path}/out")
    assert json.loads((tmp_path / "out" / "metadata.json").read_text())["uniqueDocuments"] == 1 and spark.read.json(f"{tmp_path}/out/corpus").count() == 1


# --- embedding --------------------------------------------------------------------------------------


class Picky(embed.StandIn):
    """Fails on a text, counts what it was asked, and writes it down where all workers can."""

    def __init__(self, log, bad=(), slow=()):
        super().__init__(4)
        self.log, self.bad, self.slow = log, set(bad), set(slow)

    def embed(self, texts):
        with open(self.log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        if self.slow & set(texts):
            time.sleep(20)
        if self.bad & set(texts):
            raise RuntimeError("unreadable")
        return super().embed(texts)


def test_a_failing_text_costs_itself_only(spark, tmp_path):
    corpus = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(99, None)], "doc_id long, text string")
    got = {x["doc_id"]: x["embedding"] for x in embed.embed(corpus, Picky(str(tmp_path / "log"), ["text 7"])).collect()}
    assert [k for k, v in got.items() if v is None] == [7, 99] and got[8] == pytest.approx(embed.StandIn(4).embed(["text 8"])[0].tolist())


def test_an_embedding_job_takes_up_what_is_missing(spark, tmp_path):
    path, log = str(tmp_path / "job"), tmp_path / "log"
    corpus = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    first = embed.embedding_job(corpus.where("doc_id < 30"), Picky(str(log), ["text 7"]), path, batch=8, waves=3)
    assert first == {"texts": 30, "there": 0, "embedded": 29, "failed": 1, "by_second": 0}
    log.unlink()
    changed = corpus.withColumn("text", F.when(F.col("doc_id") == 3, "new text").otherwise(F.col("text")))
    second = embed.embedding_job(changed, Picky(str(log)), path, batch=8, waves=3)
    assert second["embedded"] == 12 and second["there"] == 28 and second["failed"] == 0
    assert sorted(log.read_text().split("\n")[:-1]) == sorted([f"text {k}" for k in range(30, 40)] + ["text 7", "new text"])
    assert embed.embedded(changed, path).count() == 40
    assert embed.embedding_job(changed, Picky(str(log)), path, waves=2)["embedded"] == 0


def test_an_embedding_job_that_was_stopped_keeps_its_waves(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "job"), tmp_path / "log"
    corpus = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    calls, stamp = [], embed._stamp

    def stops(spark, where):
        calls.append(where)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return stamp(spark, where)

    monkeypatch.setattr(embed, "_stamp", stops)
    with pytest.raises(KeyboardInterrupt):
        embed.embedding_job(corpus, Picky(str(log)), path, waves=4)
    done = len(log.read_text().split("\n")) - 1
    monkeypatch.undo()
    rest = embed.embedding_job(corpus, Picky(str(log)), path, waves=4)
    assert 0 < done < 40 and rest["there"] == done and rest["embedded"] == 40 - done
    assert embed.embedded(corpus, path).count() == 40


def test_a_time_limit_ends_the_call(spark, tmp_path):
    picky = Picky(str(tmp_path / "log"), slow=["b"])
    began = time.time()
    found = embed.attempt(picky, ["a", "b", "c"], seconds=0.3)
    assert time.time() - began < 5 and [v is None for v, _, _ in found] == [False, True, False] and "TimeoutError" in found[1][2]
    pair = embed.Fallback(picky, embed.StandIn(4), seconds=0.3)
    assert len(pair.embed(["b", "c"])) == 2 and pair.answered == "second"
    pair.embed(["a"])
    assert pair.counts == {"late": 1, "second": 2, "first": 1}
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    pair = embed.Fallback(picky, embed.StandIn(4), seconds=0.3)
    counts = embed.embedding_job(corpus, pair, str(tmp_path / "job"), batch=1, waves=1)
    assert counts["by_second"] == 1
    assert {x["doc_id"]: x["provider"] for x in embed.embedded(corpus, str(tmp_path / "job")).collect()} == {1: "first", 2: "second"}
