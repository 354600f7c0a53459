"""What a plan must not do on large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cotejo.operators import aggregate, embed, index, rerank, retrieve, stored
from cotejo.plans import catalog
from cotejo.plans import retrieval_queries as queries
from cotejo.session import cut


def test_texts_are_embedded_once_and_not_where_the_table_is_read(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(3)
    plan = embed.embed(rows, embed.StandIn(4)).where(retrieve.valid_vector(F.col("embedding"), 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_weights_share_the_parts_of_a_score(spark, sf_dir, monkeypatch):
    rows = queries._candidates(spark, sf_dir)
    parts = cut(rerank.rerank_parts(rows))
    for bonus in (True, False):
        weights = {**rerank.WEIGHTS, "bm25": 0.7}
        assert not rerank.rerank(rows, weights=weights, bonus=bonus).exceptAll(rerank.weighted(parts, weights, bonus).select(rerank.rerank(rows).columns)).count()
    times = []
    parse = rerank.taxonomy.parse_query
    monkeypatch.setattr(rerank.taxonomy, "parse_query", lambda *a, **k: times.append(1) or parse(*a, **k))
    queries.weight_grid(spark, sf_dir)
    assert len(times) == 1


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    made, write = [], stored._write_blocks
    monkeypatch.setattr(stored, "_write_blocks", lambda postings, *a: made.append(postings) or write(postings, *a))
    docs = spark.createDataFrame([(k, f"the word {k % 7} the end {k % 3}") for k in range(60)], "doc_id long, text string")
    got = stored.build_bm25(docs, str(tmp_path / "index"), segment=8)
    grouped = made[0].groupBy("term", "segment").count()._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange hash") == 1 and "Exchange range" not in grouped
    plain = index.build(docs)
    assert got.blocks.agg(F.sum("n")).first()[0] == plain.postings.count()
    assert {tuple(r) for r in got.terms.select("term", "df").collect()} == {tuple(r) for r in plain.terms.collect()}


def _quotes(spark, names):
    rows = [(k, names[k % len(names)], f"s{k % 3}", "BID 1", "b", f"{k % 5},50", "12" if k % 2 else None, None) for k in range(30)]
    return spark.createDataFrame(rows, "row_idx long, description string, supplier string, source string, brand string, price string, life_months string, maintenance string")


def test_few_descriptions_are_normalised_once_each(spark, monkeypatch):
    given = _quotes(spark, ["MOP Á!", "mop a!", None, "!", "BALDE"])
    few = {r["equipment_id"]: r for r in aggregate.aggregate_quotes(given).collect()}
    assert set(few) == {"mop a", "balde"}
    plan = aggregate._with_key(given)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan
    monkeypatch.setattr(aggregate, "small", lambda df: df)
    many = {r["equipment_id"]: r for r in aggregate.aggregate_quotes(given).collect()}
    assert many == few
    row = few["balde"]  # rows 4, 9, ...: price 4,50 each; life where the number is odd
    assert row["price"].asDict() == {"display": 4.5, "mean": 4.5, "median": 4.5, "min": 4.5, "max": 4.5, "n": 6}
    assert row["life_months"]["n"] == 3 and row["maintenance"]["n"] == 0 and row["maintenance"]["mean"] is None


def test_products_are_made_once_before_they_are_numbered(spark):
    numbered = aggregate.number_documents(aggregate.aggregate_quotes(_quotes(spark, ["MOP", "BALDE"])))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert [r["id"] for r in numbered.orderBy("first_row").collect()] == ["DOC_00000", "DOC_00001"]


def _broadcast_rows(spark, run):
    """Rows of every broadcast in all that a run executes, its checkpoints too."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    wait()
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    run()
    wait()
    ran = store.executionsList()
    found = []
    for execution in {ran.apply(k).executionId() for k in range(ran.size())} - before:
        nodes, values = store.planGraph(execution).allNodes(), store.executionMetrics(execution)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            counts = [node.metrics().apply(k) for k in range(node.metrics().size())] if node.name() == "BroadcastExchange" else []
            found += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in counts if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return found


@pytest.mark.parametrize("name", ["shadow_comparison", "tfidf_hybrid_topk", "shadow_search", "smart_search"])
def test_no_step_of_a_search_broadcasts_a_row_for_each_document(spark, tmp_path, name):
    # few names and many ids, in a file whose size says little of the rows that are made of it
    spark.range(600).selectExpr("id AS p_partkey", "concat('red widget ', id % 7) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    rows = _broadcast_rows(spark, lambda: catalog.queries()[name](spark, str(tmp_path)).collect())
    assert rows and max(rows) < 500
