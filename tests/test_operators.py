from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.functions import text
from cotejo.operators import aggregate, compare, embed, index, rank, rerank, retrieve, rewrite, state
from cotejo.plans.search import SearchConfig, check_queries, embedding_search, search_texts, smart_search
from cotejo.sources import tables
from cotejo.streaming import analytics

DOCS = [(1, "mop mop mop"), (2, "mop and a long line of other words here"), (3, "mop short"), (4, ""), (5, None), (6, "mop short")]


def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_bm25_ranks_and_ties(spark):
    rows = retrieve.top_k(retrieve.bm25(corpus(spark), asked(spark, "mop")), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows][0] == 1
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[3] == scores[6] > scores[2] and set(scores) == {1, 2, 3, 6}
    assert retrieve.bm25(corpus(spark), asked(spark, "", "zzz")).count() == 0
    assert retrieve.bm25(corpus(spark).limit(0), asked(spark, "mop")).count() == 0


def test_index_round_trip(spark, tmp_path):
    built = index.build(corpus(spark))
    index.save(built, str(tmp_path / "i"))
    loaded = index.load(spark, str(tmp_path / "i"))
    assert loaded is not None and not index.is_stale(loaded, corpus(spark)) and index.is_stale(loaded, corpus(spark).limit(2))
    assert {tuple(r) for r in loaded.postings.collect()} == {tuple(r) for r in built.postings.collect()}
    spark.createDataFrame([(9, "x", 1)], "doc_id int, term string, tf long").write.mode("append").parquet(str(tmp_path / "i/postings"))
    assert index.load(spark, str(tmp_path / "i")) is None
    assert index.load(spark, str(tmp_path / "none")) is None


def brute_fuzzy(token, vocabulary):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    if token in vocabulary or len(token) < 4:
        return token
    best = [(-(1 - d / max(len(token), len(w))), k, w) for k, w in enumerate(vocabulary) if (d := distance(token, w)) <= 2 and 1 - d / max(len(token), len(w)) >= 0.75]
    return min(best)[2] if best else token


def test_fuzzy_join_finds_what_comparing_all_pairs_finds(spark):
    words = ["vassoura", "vassouras", "lavadora", "aspirador", "balde", "mop", "enceradeira", "extratora", "abcd", "abcdefgh", "xbcdefgx"]
    typos = ["vasoura", "vassuora", "lavdora", "aspiradr", "bald", "mopp", "enceradiera", "extratoras", "abce", "zabcdefgh", "abdefgh", "xxabcdefgh", "cdefgh", "qqqqqq", "abcdefghij"]
    vocabulary = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "term string, ord int")
    found = {r["token"]: r["corrected"] for r in rewrite.correct_tokens(spark.createDataFrame([(t,) for t in typos], "token string"), vocabulary).collect()}
    assert found == {t: brute_fuzzy(t, words) for t in typos}


def test_entity_lists(spark):
    given = ["a, b", "7,5, x", "R$ 10, casa", "casa, rua", "1, 2", "só um", None]
    rows = spark.createDataFrame([(v,) for v in given], "v string").select(rewrite.entity_list(F.col("v")).alias("l")).collect()
    assert [r["l"] for r in rows] == [["a", "b"], None, None if rows[2]["l"] is None else rows[2]["l"], ["casa", "rua"], None, None, None]


def test_guard_moves_equipment_first(spark):
    docs = spark.createDataFrame([(0, "enceradeira", 1, "disco enceradeira", 9.0), (0, "enceradeira", 2, "enceradeira 510", 1.0)], "query_id int, query string, doc_id int, text string, score double")
    scored = rerank.rerank(docs, weights={**rerank.WEIGHTS, "accessory": 0.0})
    ranks = {r["doc_id"]: (r["rank"], r["guarded_rank"]) for r in rerank.guard_first(scored).collect()}
    assert ranks == {1: (1, 2), 2: (2, 1)}


def plain_confidence(query, top, s1, s2, best):
    """The confidence of a first result, phase by phase, as a plain function."""
    import re

    q = re.sub(r"[/()]", " ", query.lower().strip())
    words = [w for w in q.split() if len(w) > 1]
    top = re.sub(r"[/()]", " ", top.lower())
    size = len([w for w in top.split() if len(w) > 1])
    numbers = [w for w in words if re.fullmatch(r"\d+[a-z]*|[a-z]*\d+", w)]
    keys = [w for w in words if w not in numbers and len(w) >= 4 and w not in rank.COMMON_WORDS]
    hit, hn, hk = (sum(w in top for w in x) for x in (words, numbers, keys))
    cov = hit / len(words) if words else 0
    nr, kr = hn / len(numbers) if numbers else 1, hk / len(keys) if keys else 1
    total = cov * 0.15 + nr * 0.10 + kr * 0.05
    order = 0.0
    if len(words) >= 2:
        runs = sum(2 * n for n in range(2, min(len(words), 4) + 1) for i in range(len(words) - n + 1) if " ".join(words[i : i + n]) in top)
        at, found = -1, 0
        for w in words:
            place = top.find(w, at + 1)
            if place <= at:
                break
            at, found = place, found + 1
        order = found / len(words) * 0.10 + min(1, runs / (2 * len(words))) * 0.10 + 0.03 * (q in top) + 0.02 * (bool(keys) and top.startswith(keys[0]))
        total += 0.02 * (found == len(words))
    norm, gap = min(1, s1 / best) if best else 0, (s1 - s2) / s1 if s1 else 0
    density = hit / size if size else 0
    total += order + norm * 0.12 + gap * 0.08 + density * 0.08 + cov * 0.07
    missing = bool(numbers) and hn < len(numbers)
    total += 0.05 * (cov >= 0.95 and order > 0.15) + 0.03 * (bool(numbers) and not missing) + 0.02 * (s1 > 20)
    total -= 0.30 * (1 - nr) * missing + (0.20 * (1 - kr) if hk < len(keys) else 0) + (0.25 * (0.5 - cov) / 0.5 if cov < 0.5 else 0) + 0.15 * (len(words) >= 2 and order < 0.05)
    total -= (0.20 * (1 - s1 / 4) if s1 < 4 else 0) + 0.10 * (s1 > 0 and s2 > 0 and gap < 0.15) + 0.08 * (density < 0.3 and size > 10)
    total = min(1, max(0, total))
    total = min(total, 0.60) if missing else total
    total = min(total, 0.65) if cov < 0.7 else total
    total = min(total, 0.50) if norm < 0.3 else total
    return total if best > 0 else 0.0


def test_global_confidence_follows_the_phases(spark, sf_dir):
    from cotejo.plans.retrieval_queries import _confidence_rows

    rows = rank.global_confidence(_confidence_rows(spark, sf_dir)).collect()
    assert len({r["level"] for r in rows}) == 3
    for r in rows:
        assert r["confidence"] == pytest.approx(plain_confidence(r["query"], r["top_text"], r["s1"], r["s2"], r["max_score"]), abs=2e-6), r


def plain_diversify(items, asked, top_k, cap, cover):
    taken, counts = [], {}
    cover = max(0, min(cover, top_k))

    def take(d, capped):
        if d in taken or capped and counts.get(d["s"], 0) >= cap:
            return
        taken.append(d)
        counts[d["s"]] = counts.get(d["s"], 0) + 1

    own = [d for d in items if asked and d["c"] == asked]
    if asked and len(own) >= cover > 0:
        for d in own:
            if len(taken) >= cover:
                break
            take(d, True)
    for capped in (True, False):
        for d in items:
            if len(taken) >= top_k:
                break
            if asked and d["c"] != asked and len(taken) < cover:
                continue
            take(d, capped)
    return [d["id"] for d in taken]


@pytest.mark.parametrize("asked_for", ["MOP", None])
def test_diversify_is_the_greedy_selection(spark, asked_for):
    items = [{"id": str(k), "s": f"t{k * k % 5}", "c": "MOP" if k % 3 else "X"} for k in range(40)]
    rows = spark.createDataFrame([(1, k, d["id"], d["s"], d["c"], asked_for) for k, d in enumerate(items)], "query_id int, rank int, doc_id string, subtype string, category string, query_category string")
    for top_k, cap, cover in ((10, 1, 5), (12, 2, 3), (50, 1, 5)):
        got = [r["doc_id"] for r in rank.diversify(rows, top_k, cap, cover).orderBy("place").collect()]
        assert got == plain_diversify(items, asked_for, top_k, cap, cover)


def test_item_confidence_never_rises(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (0, 3, 0.1)], "query_id int, rank int, final_score double")
    got = [r["confidence"] for r in rank.item_confidence(rows, F.lit(1.0)).orderBy("rank").collect()]
    assert got == sorted(got, reverse=True) and got[1] == got[0]


def test_compare_of_nothing_in_common(spark):
    a = spark.createDataFrame([(0, 1, 1, 0.5)], "query_id int, doc_id int, rank int, score double")
    b = spark.createDataFrame([(0, 2, 1, 0.5)], "query_id int, doc_id int, rank int, score double")
    r = compare.compare(a, b).first()
    assert (r["jaccard"], r["rank_difference"], r["score_error"], r["only_a"], r["only_b"], r["agrees"]) == (0, 0, 0, 1, 1, False)


def test_quotes_aggregate(spark):
    rows = [
        (1, "Mop Pó", "A", "b1", "x", "10,00", "12", "5"), (2, "mop po!", "B", "b1", None, "1.000,00", "-", "0,5"), (3, "", "C", "b2", "y", "9", "1", "1"), (4, None, "C", "b2", "y", "9", "1", "1"), (5, "MOP PO", " A ", "b3", "x", "-1", "24", None),
    ]
    df = spark.createDataFrame(rows, "row_idx long, description string, supplier string, source string, brand string, price string, life_months string, maintenance string")
    (r,) = aggregate.aggregate_quotes(df).collect()
    assert (r["title"], r["rows"], r["price"]["n"], r["price"]["median"], r["life_months"]["mean"]) == ("Mop Pó", 3, 2, 505.0, 18.0)
    assert r["maintenance"]["mean"] == pytest.approx(0.275) and r["suppliers"] == ["A", "B"] and r["sources"] == ["b1", "b3"] and r["brands"] == ["x"]
    assert aggregate.number_documents(aggregate.aggregate_quotes(df)).first()["id"] == "DOC_00000"
    assert aggregate.aggregate_quotes(df.limit(0)).count() == 0


def test_budget_and_upsert(spark):
    kit = spark.createDataFrame([("u", 10.0, 2), ("u", None, 3), ("u", 1.5, 0), ("v", 2.0, None)], "user string, price double, qty int")
    got = {r["user"]: (r["items"], r["units"], r["total"]) for r in state.budget(kit, "user", "price", "qty").collect()}
    assert got == {"u": (3, 6, 21.5), "v": (1, 1, 2.0)}
    old = spark.createDataFrame([("u", 1, "a"), ("v", 1, "b")], "user string, t int, data string")
    new = spark.createDataFrame([("u", 2, "c")], "user string, t int, data string")
    assert {(r["user"], r["data"]) for r in state.upsert_latest(old, new, "user", "t", "data").collect()} == {("u", "c"), ("v", "b")}


def test_search(spark):
    docs = [(1, "Enceradeira industrial 510 mm"), (2, "Disco para enceradeira 510"), (3, "Vassoura nylon"), (4, "Vassoura piaçava"), (5, "Aspirador de pó"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    rows = search_texts(spark, df, ["enceradera 510", "vassoura", "zzz"], SearchConfig(top_k=3)).orderBy("query_id", "rank").collect()
    assert rows[0]["doc_id"] == 1 and {r["doc_id"] for r in rows if r["query_id"] == 1} == {3, 4}
    assert all(0 <= r["list_confidence"] <= 1 for r in rows)


@pytest.mark.parametrize("bad", [[""], ["x" * 501], ["a"] * 51])
def test_bounds_of_queries(bad):
    with pytest.raises(ValueError):
        check_queries(bad, 50)
    with pytest.raises(ValueError):
        SearchConfig(top_k=0)


def test_corpus_shapes(spark, tmp_path):
    doc = {"id": "DOC_1", "title": "Mop", "text": "mop", "metrics": {"valorUnitario": {"display": 9.5}, "manutencao": {"display": 0.05, "unit": "fraction"}}}
    old = {"grupo": "G1", "descricao": "balde", "marca": "X", "valor_unitario": 3.0}
    for name, content in (("a", [old]), ("b", [{"metadata": {"n": 1}, "corpus": [doc]}]), ("c", {"metadata": {"n": 1}, "corpus": [doc]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    (a,), (b,), (c,) = (tables.read_corpus(spark, str(tmp_path / f"{n}.json")).collect() for n in "abc")
    assert (a["id"], a["text"], a["brand"], a["price"]) == ("G1", "balde", "X", 3.0)
    assert b == c and (b["price"], b["maintenance_percent"]) == (9.5, 5.0)


def test_csv_and_versions(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Descrição,Valor\nmop,\"1,50\"\nbalde,2\n")
    rows = tables.read_quotes(spark, str(tmp_path / "q.csv"), {"Descrição": "description", "Valor": "price", "Marca": "brand"}).orderBy("row_idx").collect()
    assert [(r["description"], r["price"], r["brand"]) for r in rows] == [("mop", "1,50", None), ("balde", "2", None)]
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert tables.write_corpus(df, str(tmp_path / "v")) == tables.write_corpus(df, str(tmp_path / "v"))
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["b"] == "N/A"
    assert tables.read_abbreviations(spark, str(tmp_path / "none.json")) is None


def test_daily_table_of_a_stream(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = analytics.read_events(spark, str(tmp_path / "in"), source.schema, files_per_trigger=1)
    analytics.keep_daily(stream, str(tmp_path / "daily"), str(tmp_path / "cp"))
    last = spark.read.parquet(str(tmp_path / "daily/version=2"))
    assert last.agg(F.sum("total_queries")).first()[0] == source.count()


def test_embedding_job_keeps_valid_vectors(spark):
    rows = [(1, "a", None), (2, "a", [1.0, 0.0, 0.0, 0.0]), (3, "b", [0.0, 0.0, 0.0, 0.0]), (4, None, None), (5, " ", [1.0])]
    df = spark.createDataFrame(rows, "id int, text string, embedding array<double>")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, embed.StandIn(4), batch=1).collect()}
    assert got[2] == [1.0, 0.0, 0.0, 0.0] and got[4] is None and got[5] is None
    assert sum(x * x for x in got[1]) == pytest.approx(1) and got[1] != got[3]
    assert embed.StandIn.seed("") == 5381 and embed.StandIn.seed("a") == abs(5381 * 33 ^ 97)


def test_smart_search_adds_its_parts_up(spark):
    docs = [(1, "Enceradeira industrial 510 mm"), (2, "Disco para enceradeira 510"), (3, "Vassoura nylon"), (4, None), (5, "notebook")]
    df, queries = spark.createDataFrame(docs, "doc_id int, text string"), asked(spark, "enceradeira 510", "vassoura", "")
    rows = smart_search(df, queries, embed.StandIn(8), top_k=2).collect()
    assert rows and {r["query_id"] for r in rows} == {0, 1}
    for r in rows:
        assert r["score"] == pytest.approx(0.25 * r["tfidf"] + 0.40 * r["semantic"] + 0.20 * r["cross_norm"] + 0.15 * r["domain"], abs=2e-6)
    same = embedding_search(df, asked(spark, "Vassoura NYLON"), embed.StandIn(8), top_k=1).first()
    assert same["doc_id"] == 3 and same["score"] == pytest.approx(1)


def test_corpus_gets_its_domain(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "text": "mop"}, {"id": "2", "text": "x", "domain": "peripheral"}]))
    got = {r["id"]: (r["domain"], r["domain_confidence"]) for r in tables.with_domain(tables.read_corpus(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {"1": ("cleaning_support", 0.9), "2": ("peripheral", 1.0)}


def test_dense_search_works_through_blocks_of_queries(spark, monkeypatch):
    rows = [(k, [float((k * 7 + j * 3) % 11) + 1.0 for j in range(4)]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = vectors.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, retrieve.dense_top(vectors, queries, 3, 4).collect()))
    monkeypatch.setattr(retrieve, "MOST_QUERIES", 16)
    assert sorted(map(tuple, retrieve.dense_top(vectors, queries, 3, 4).collect())) == whole and len(whole) == 120


def test_rewrite_plan_and_synonyms_by_hand(spark):
    maps = rewrite.Abbreviations({"vassoura": "vassoura nylon", "lav piso": "lavadora de piso"}, {"asp": "aspirador", "hp": "potencia"}, {"discos": ["disco verde", "disco preto", "discos"]})
    asked = spark.createDataFrame([(1, "Vassoura"), (2, "lav  piso"), (3, "asp 2 hp"), (4, "discos"), (5, "mop")], "query_id int, query string")
    plan = {tuple(r) for r in rewrite.rewrite_plan(asked, maps).select("query_id", "ord", "query", "weight", "reason").collect()}
    assert plan == {
        (1, 1, "vassoura", 1.0, "primary"), (1, 2, "vassoura nylon", 0.6, "exactMap"), (2, 1, "lavadora de piso", 1.0, "primary"), (3, 1, "aspirador 2 potencia", 1.0, "primary"),
        (4, 1, "discos", 1.0, "primary"), (4, 2, "disco verde", 0.6, "expandMap"), (4, 3, "disco preto", 0.6, "expandMap"), (5, 1, "mop", 1.0, "primary"),
    }
    asked = spark.createDataFrame([(1, "Mop industrial"), (2, "balde inox"), (3, "xyz"), (4, "piso nylon")], "query_id int, query string")
    variants = {r["query_id"]: r["variants"] for r in asked.select("query_id", F.array_join(rewrite.expand_synonyms(F.col("query")), "|").alias("variants")).collect()}
    assert variants == {
        1: "mop industrial|esfregão industrial|rodo úmido industrial|vassoura úmida industrial|esfregona industrial",
        2: "balde inox|bacia inox|recipiente inox|cuba inox|balde aço inox", 3: "xyz", 4: "piso nylon|piso náilon|piso nailon",
    }


def test_quotes_of_one_value_are_not_gathered(spark):
    """Medians of even and odd counts, of one value, and none; provenance in order of first sight."""
    from cotejo.operators import aggregate

    rows = [(k, "Mop", ["b", "a", "b"][k % 3], "s", None, str(v), None, "5") for k, v in enumerate([4, 1, 3, 2])] + [(9, "Pad", None, "", "x", "0", "7", None)]
    quotes = spark.createDataFrame(rows, "row_idx long, description string, supplier string, source string, brand string, price string, life_months string, maintenance string")
    got = {r["equipment_id"]: r for r in aggregate.aggregate_quotes(quotes).collect()}
    assert got["mop"]["price"]["median"] == 2.5 and got["mop"]["price"]["n"] == 4 and got["mop"]["suppliers"] == ["b", "a"]
    assert got["pad"]["price"]["median"] is None and got["pad"]["life_months"]["display"] == 7 and got["pad"]["suppliers"] == [] and got["pad"]["brands"] == ["x"]


def test_search_shows_several_subtypes_where_a_query_navigates(spark):
    from cotejo.plans.search import SearchConfig, search_texts

    kinds = ["nylon", "piacava", "feiticeira", "teto", "gari", "sanitaria"]
    corpus = spark.createDataFrame([(10 * k + j, f"VASSOURA {kind.upper()}") for k, kind in enumerate(kinds) for j in range(6)], "doc_id long, text string")
    rows = search_texts(spark, corpus, ["vassoura", "vassoura nylon 40"], SearchConfig(top_k=5)).orderBy("query_id", "rank").collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    first = [r for r in rows if r["query_id"] == 0]
    assert [r["rank"] for r in first] == [1, 2, 3, 4, 5] and len({texts[r["doc_id"]] for r in first}) >= 3
    assert len({r["doc_id"] for r in rows if r["query_id"] == 1}) == 5


def test_parts_around_the_search(spark, tmp_path):
    """Confidence by method, cross scores from pairs, vocabularies, exempt users, exports, fallbacks and modes."""
    from cotejo.operators import embed, index, rank, rerank, state
    from cotejo.plans.search import engine_mode
    from cotejo.sources import tables

    rows = spark.createDataFrame([(1, 1, None, 2.0), (1, 2, 3.0, 9.0), (1, 3, None, 1.0)], "query_id int, doc_id int, a double, b double")
    assert [(r["doc_id"], r["confidence"]) for r in rank.confidence(rows, "a", "b").orderBy("rank").collect()] == [(2, 1.0), (1, 0.5), (3, 0.0)]
    soft = rank.confidence(rows, "a", "b", method="softmax").collect()
    assert abs(sum(r["confidence"] for r in soft) - 1) < 1e-5
    pairs = spark.createDataFrame([("Mop  Úmido", "RODO", 0.7)], "query string, doc string, score double")
    asked = spark.createDataFrame([("mop úmido", "rodo"), ("mop", "rodo")], "query string, text string")
    assert [r["cross"] for r in rerank.listed_cross(asked, pairs).orderBy(F.desc("query")).collect()] == [0.7, 0.0]
    assert {r["cross"] for r in rerank.no_cross(asked).collect()} == {0.5}
    words = index.vocabulary(spark.createDataFrame([(1, "mop rodo")], "doc_id long, text string"))
    more = index.with_terms(words, spark.createDataFrame([("MOP",), ("Balde",)], "term string"))
    index.save_vocabulary(more, f"{tmp_path}/v")
    assert {r["term"] for r in index.load_vocabulary(spark, f"{tmp_path}/v").collect()} == {"mop", "rodo", "balde"}
    hits = spark.sql("select u, timestamp'2024-01-01 00:00:00' as t from values ('127.0.0.1'), ('10.0.0.1') as x(u), range(3)")
    assert [r["u"] for r in state.over_limit(hits, "u", "t", most=2).collect()] == ["10.0.0.1"]
    row = state.cart_summary(spark.createDataFrame([(2.0, 3), (4.0, 1)], "p double, q int"), "p", "q").first()
    assert tuple(row) == (2, 4, 10.0, 2.5)
    tables.write_favourites(spark.createDataFrame([("Mop", None, 2.5, None, None, 0.876, None)], "name string, description string, price double, life_months int, maintenance double, confidence double, brand string").coalesce(1), f"{tmp_path}/f")
    text = next((tmp_path / "f").glob("*.csv")).read_text(encoding="utf-8").splitlines()
    assert text[0].startswith("\ufeffEquipamento,Descrição Original") and text[1] == "Mop,,2.5,N/A,N/A,88,N/A"
    listed = embed.Listed({"a": [1.0, 2.0]}, 2)

    class Broken:
        dimension = 2

        def embed(self, texts):
            raise OSError("away")

    found = embed.Fallback(Broken(), listed).embed(["a", "b"])
    assert [list(v) for v in found] == [[1.0, 2.0], [0.0, 0.0]]
    assert [engine_mode(x) for x in (None, "Python", "dual ", "x")] == ["ts", "python", "dual", "ts"]


def test_diversify_query_is_the_greedy_selection(spark, sf_dir):
    from cotejo.plans import retrieval_queries as q

    lists = {}
    for r in q._subtypes(spark, sf_dir).orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append({"id": str(r["doc_id"]), "s": r["subtype"], "c": r["category"]})
    got = {}
    for r in q.diversify(spark, sf_dir).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {k: plain_diversify(items, "gear", 10, rank.MAX_PER_SUBTYPE, rank.MIN_COVERAGE) for k, items in lists.items()}


def test_embedding_search_is_that_of_brute_force(spark, sf_dir):
    """Every row of embedding_search, by numpy."""
    from cotejo.functions.text import normalize_equipment
    from cotejo.plans import catalog
    from cotejo.plans import retrieval_queries as q

    normal = lambda df, key, column: {r[0]: r[1] for r in df.select(key, normalize_equipment(F.col(column))).collect()}
    docs, asked = normal(q.parts(spark, sf_dir), "doc_id", "text"), normal(q.part_queries(spark), "query_id", "query")
    ids = sorted(docs)
    matrix = np.vstack(embed.StandIn(32).embed([docs[k] for k in ids]))
    expected = []
    for query_id, text in asked.items():
        scores = np.round(matrix @ embed.StandIn(32).embed([text])[0], 6)
        best = sorted(zip(-scores, ids, strict=True))[:10]
        expected += [(query_id, doc_id, round(float(-s), 6), place) for place, (s, doc_id) in enumerate(best, 1)]
    got = [(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in catalog.queries()["embedding_search"](spark, sf_dir).collect()]
    assert [g[:2] + g[3:] for g in sorted(got)] == [e[:2] + e[3:] for e in sorted(expected)]
    assert max(abs(g[2] - e[2]) for g, e in zip(sorted(got), sorted(expected), strict=True)) < 2e-6


def test_smart_search_is_that_of_brute_force(spark, sf_dir):
    """Every row of smart_search: candidates from the hybrid, the rest computed anew."""
    from cotejo.functions import attributes, domain
    from cotejo.functions.text import normalize_equipment
    from cotejo.plans import retrieval_queries as q

    corpus, asked = q.parts(spark, sf_dir), q.part_queries(spark).withColumn("norm", normalize_equipment(F.col("query")))
    found = retrieve.tfidf_hybrid(corpus.select("doc_id", normalize_equipment(F.col("text")).alias("text")), asked.select("query_id", F.col("norm").alias("query")), 50)
    rows = found.select("query_id", "doc_id", F.col("score").alias("tfidf")).join(corpus, "doc_id").join(asked, "query_id")
    rows = rows.withColumn("domain", domain.domain_score(domain.classify(F.col("query")), domain.classify(F.col("text"))))
    rows = rows.withColumn("numeric", attributes.numeric_boost(attributes.full_attributes(F.col("query")), attributes.full_attributes(F.col("text"))))
    vector = lambda text: embed.StandIn(32).embed([text])[0]
    expected = set()
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["query_id"], []).append(r.asDict())
    for query_id, listed in groups.items():
        for r in listed:
            r["semantic"] = float(vector(r["norm"]) @ vector(r["text"]))
            wanted, there = r["query"].lower().split(), r["text"].lower().split()
            hits = sum(w in there for w in wanted)
            r["cross"] = 2 * hits / (len(there) + len(wanted)) if hits else 0.0
        gate = max(r["semantic"] for r in listed) < 0.75
        top = sorted(listed, key=lambda r: (-r["semantic"], r["doc_id"]))[:20] if gate else []
        low, high = (min(r["cross"] for r in top), max(r["cross"] for r in top)) if top else (0, 0)
        for r in listed:
            r["cross_norm"] = (0.5 if high - low < 1e-9 else (r["cross"] - low) / (high - low)) if r in top else 0.0
            r["score"] = round(0.25 * r["tfidf"] + 0.40 * r["semantic"] + 0.20 * r["cross_norm"] + 0.15 * r["domain"], 6)
        expected |= {(query_id, k, r["doc_id"], r["score"]) for k, r in enumerate(sorted(listed, key=lambda r: (-r["score"], r["doc_id"]))[:10], 1)}
    got = {(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in q.smart(spark, sf_dir).collect()}
    assert {g[:3] for g in got} == {e[:3] for e in expected}
    assert {g[:3]: g[3] for g in got} == pytest.approx({e[:3]: e[3] for e in expected}, abs=2e-6)


def broadcast_rows(plan):
    """Rows of all broadcasts of a plan that has run."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else []
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    return own + [n for p in inner + below for n in broadcast_rows(p)]


def test_tfidf_broadcasts_no_side_that_has_a_row_for_each_document(spark, tmp_path):
    # of a table in a file, whose size says little of the rows that are made of it
    spark.range(500).selectExpr("id AS doc_id", "concat('red widget ', id % 7) AS text").write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    asked = spark.createDataFrame([(1, "red"), (2, "widget 3"), (3, "zzz")], "query_id int, query string")
    for rows in (retrieve.tfidf_top(corpus, asked, text.char_ngrams, 5), retrieve.tfidf_hybrid(corpus, asked, 5)):
        rows.collect()
        assert max(broadcast_rows(rows._jdf.queryExecution().executedPlan())) < 400


def test_a_worker_holds_a_bounded_block_of_scores():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    docs, asked = rng.integers(-3, 4, (3000, 8)) / 7.0, rng.integers(-3, 4, (2000, 8)) / 7.0
    block = pd.DataFrame({"query_id": range(2000), "q": list(asked)})
    batches = [pd.DataFrame({"doc_id": range(at, at + 1500), "u": list(docs[at : at + 1500])}) for at in (0, 1500)]
    run = retrieve._best_of_block(block, 5)
    tracemalloc.start()
    (found,) = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = np.round(docs @ asked.T, 6) + 0.0
    for query in range(0, 2000, 37):
        want = sorted(range(3000), key=lambda d: (-score[d, query], d))[:5]
        assert found[found["query_id"] == query]["doc_id"].tolist() == want
    assert peak < 60 << 20, peak
