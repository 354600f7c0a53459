"""The stages of the pipeline, each against what it should do to its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from cotejo.llm import mixing, secrets, toxicity
from tests.llm.test_operators import clusters, odd_docs, word_sets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secrets", "mixing", "sentencepiece"]
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.dtypes == before.dtypes
        kept.append((before, docs))

    bad = {r["doc_id"] for r in toxicity.score(kept[0][0], toxicity.learn(kept[0][0], labels)).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept[0][0].collect()} - {r["doc_id"] for r in kept[0][1].collect()} == bad
    rows = sorted((r["doc_id"], r["text"]) for r in kept[1][0].collect())
    sets = word_sets(rows)
    group = clusters(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    left, first = {r["doc_id"] for r in kept[1][1].collect()}, {rows[k][0] for k in group.values()}
    assert first <= left and len(left - first) <= 0.1 * (len(rows) - len(first))
    hidden = {r["doc_id"] for r in secrets.scan(kept[2][0]).where("spans <> ''").collect()}
    old = {r["doc_id"]: r["text"] for r in kept[2][0].collect()}
    for r in kept[2][1].collect():
        assert (r["text"] != old[r["doc_id"]]) == (r["doc_id"] in hidden) and r["n_chars"] == len(r["text"])
    assert secrets.scan(kept[2][1]).where("n_assign + n_access + n_hex > 0").count() == 0
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(kept[3][0]).where("taken > 0").collect()}
    held: Counter = Counter()
    for r in kept[3][1].collect():
        held[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert dict(held) == taken
    assert kept[4][1].where("not exact").count() == 0 and kept[4][1].count() == kept[4][0].count()


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids"} <= set(rows.columns) and rows.count() > 0


def test_a_run_goes_on_where_it_failed(spark, sf_dir, tmp_path, monkeypatch):
    calls = []

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if name == "mixing" and calls.count("mixing") == 1:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, run

    whole = corpus_pipeline.run(spark, sf_dir)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in corpus_pipeline.STAGES])
    folder = f"{tmp_path}/run"
    try:
        corpus_pipeline.run(spark, sf_dir, folder)
    except RuntimeError:
        pass
    again = corpus_pipeline.run(spark, sf_dir, folder)
    assert calls == ["toxicity", "simhash_near_dedup", "secrets", "mixing", "mixing", "sentencepiece"]
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    assert [p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")] == ["3-mixing"]


def test_stages_take_odd_rows(spark, sf_dir):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
