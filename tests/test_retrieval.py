"""BM25 golden values, padding and ties; prompts; posteriors."""

import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import prompts as P
from gleanery.functions import vectors as V
from gleanery.operators import blocks, bm25, posterior
from gleanery.plans import views
from gleanery.plans.registered import QUERIES
from gleanery.plans.views import digest_scorer


def brute(docs, queries, n):
    split = lambda t: re.findall("[A-Za-z0-9]+", t.lower())
    toks = [split(f"{'None' if t is None else t} {x}") for t, x in docs]
    avg = sum(map(len, toks)) / len(toks)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(docs) - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, q in enumerate(queries):
        scores = []
        for j, t in enumerate(toks):
            s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in split(q) if w in t)
            scores.append((-round(s, 9), j))
        out[i] = [(j, -s) for s, j in sorted(scores)[:n]]
    return out


@pytest.mark.parametrize("size", [3, 30])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    docs = [(rng.choice([None, "T1", "t2"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(size)]
    docs[-1] = docs[0]
    queries = [" ".join(rng.choice(words) for _ in range(3)) for _ in range(5)] + ["nothing known", "alpha alpha alpha", ""]
    c = spark.createDataFrame([(i, f"d{i}", t, x) for i, (t, x) in enumerate(docs)], "doc_ord long, doc_id string, title string, text string")
    q = spark.createDataFrame([(i, x, "SUPPORTS", "test") for i, x in enumerate(queries)], "id long, query string, label string, split string")
    for n in (2, 5, 40):
        got = {}
        for r in bm25.retrieve(q, c, n).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["doc_ord"], pytest.approx(r["score"], abs=1e-8)))
        assert got == brute(docs, queries, n)


def test_thresholds_lose_no_document(spark):
    """Skewed terms and long queries, so that blocks and idle terms are left out."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    pick = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.35)) - 1)] for _ in range(n))
    docs = [(rng.choice(["T1", "t2"]), pick(rng.randint(1, 60))) for _ in range(400)]
    queries = [pick(rng.choice([1, 2, 5, 25])) for _ in range(40)] + ["w0", "w1 w1 w2", docs[7][1]]
    c = spark.createDataFrame([(i, f"d{i}", t, x) for i, (t, x) in enumerate(docs)], "doc_ord long, doc_id string, title string, text string")
    q = spark.createDataFrame([(i, x, "SUPPORTS", "test") for i, x in enumerate(queries)], "id long, query string, label string, split string")
    index = bm25.build_index(c)
    for n in (1, 7):
        got = {}
        for r in bm25.retrieve(q, c, n, index).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["doc_ord"], pytest.approx(r["score"], abs=1e-8)))
        assert got == brute(docs, queries, n)
    plan = bm25.scores(q, index)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" not in plan  # a document's score is summed up where its postings lie


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_few_rows_are_written_before_ranking(spark):
    found = bm25.best_scores(views.queries(spark, "/root/testdata/sf0.1"), views.index(spark, "/root/testdata/sf0.1"), views.TOP_N)
    assert found.count() <= views.TOP_N * views.queries(spark, "/root/testdata/sf0.1").count()


def shuffled_rows(spark, job):
    """The rows that each stage of ``job()`` wrote for a shuffle."""
    store, doubles = spark._jsc.sc().statusStore(), spark._jvm.double

    def seen():
        time.sleep(1)  # the store follows the jobs
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(doubles, 0), spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    before = seen()
    job()
    return [n for k, n in seen().items() if k not in before]


@pytest.mark.parametrize("pairs", [bm25.PAIRS, 0])
def test_no_search_shuffles_the_postings(spark, monkeypatch, pairs):
    """Neither the index nor a search (in one pass, or with idle terms added to what was met) shuffles a row for each posting."""
    monkeypatch.setattr(bm25, "PAIRS", pairs)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"T{i % 3}", " ".join(rng.sample(words, 50)), " ".join(rng.choice(words) for _ in range(30))) for i in range(600)]
    c = spark.createDataFrame([(i, f"d{i}", t, x) for i, (t, x, _) in enumerate(docs)], "doc_ord long, doc_id string, title string, text string")
    q = spark.createDataFrame([(i, x, "SUPPORTS", "test") for i, (_, _, x) in enumerate(docs[:30])], "id long, query string, label string, split string")
    got = {}

    def job():
        for r in bm25.retrieve(q, c, 5, bm25.build_index(c)).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["doc_ord"], pytest.approx(r["score"], abs=1e-8)))

    rows = shuffled_rows(spark, job)
    assert got == brute([(t, x) for t, x, _ in docs], [x for _, _, x in docs[:30]], 5)
    assert max(rows) < 600 * 50 / 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_no_registered_search_shuffles_the_postings(spark, monkeypatch):
    """No stage of bm25_top_n, the index included, writes a shuffle row for each posting."""
    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(views, "_indexes", {})
    rows = shuffled_rows(spark, lambda: QUERIES["bm25_top_n"](spark, d).write.format("noop").mode("overwrite").save())
    assert max(rows) < views.index(spark, d).terms.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_postings_are_shuffled_once(spark):
    n = QUERIES["postings"](spark, "/root/testdata/sf0.01").count()
    rows = shuffled_rows(spark, lambda: QUERIES["postings"](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save())
    assert sum(r >= n for r in rows) <= 1


def test_term_lists(spark):
    c = spark.createDataFrame([(0, None, "B a-b  A 9 a"), (1, "", None), (2, "x", "")], "doc_ord long, title string, text string")
    lists = {r["doc_ord"]: (r["length"], [tuple(p) for p in r["postings"]]) for r in bm25.term_lists(c).collect()}
    assert lists == {0: (7, [("9", 1), ("a", 3), ("b", 2), ("none", 1)]), 1: (0, []), 2: (1, [("x", 1)])}
    assert sorted(map(tuple, bm25.document_terms(c).collect())) == [(0, "9", 1, 7), (0, "a", 3, 7), (0, "b", 2, 7), (0, "none", 1, 7), (2, "x", 1, 1)]


def test_many_queries_in_rounds(spark, monkeypatch):
    """Thresholds from earlier rounds of documents and parts of the queries lose no document, ties included; the index shuffles no text."""
    monkeypatch.setattr(bm25, "PAIRS", 0)
    monkeypatch.setattr(blocks, "FIRST_DOCS", 30)
    monkeypatch.setattr(blocks, "QUERY_TERMS", 120)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    pick = lambda n: " ".join(words[min(199, int(rng.paretovariate(0.4)) - 1)] for _ in range(n))
    docs = [(rng.choice(["T1", None]), pick(rng.randint(0, 40))) for _ in range(500)]
    docs[400:420] = docs[:20]
    queries = [pick(rng.choice([1, 2, 5, 25])) for _ in range(40)] + ["w0", "w1 w1 w2", docs[7][1], "nothing known", ""]
    queries += [queries[3], " ".join(reversed(queries[3].split()))]
    c = spark.createDataFrame([(i, i % 7, t, x) for i, (t, x) in enumerate(docs)], "doc_ord long, page int, title string, text string")
    q = spark.createDataFrame([(f"q{i:03}", x) for i, x in enumerate(queries)], "id string, query string")
    index = bm25.build_index_in_place(c, ("page",))
    assert index.lists.where("page != doc_ord % 7").count() == 0
    for n in (1, 7):
        got = {}
        for r in bm25.retrieve(q, c, n, index).orderBy("id", "rank").collect():
            got.setdefault(int(r["id"][1:]), []).append((r["doc_ord"], pytest.approx(r["score"], abs=1e-8)))
        assert got == brute(docs, queries, n)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_recall_of_many_claims_shuffles_little(spark):
    """Neither a text nor a row for each pair of a claim and a passage is shuffled: all stages together write less than twice what the texts have."""
    store, doubles = spark._jsc.sc().statusStore(), spark._jvm.double

    def seen():
        time.sleep(1)  # the store follows the jobs
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(doubles, 0), spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = seen()
    assert QUERIES["evidence_recall"](spark, "/root/testdata/sf0.01").count() == 399
    assert sum(n for k, n in seen().items() if k not in before) < 2 * 2_409_870


def test_terms_of_a_document_are_found_once(spark):
    """No part of the plan goes over a document's words again for each of them."""
    c = spark.createDataFrame([(0, None, "B a-b  A 9 a"), (1, "", None), (2, "x", ""), (3, "x", "y " * 20_000)], "doc_ord long, title string, text string")
    plan = bm25.document_terms(c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(transform(") == 1
    words = bm25.document_words(c)
    assert words._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(map(tuple, words.collect())) == [(0, "9"), (0, "a"), (0, "b"), (0, "none"), (2, "x"), (3, "x"), (3, "y")]
    assert (3, "y", 20_000, 20_001) in map(tuple, bm25.document_terms(c).collect())


def test_prompt_texts(spark):
    row = spark.range(1).select(
        P.claim_prompt(F.lit("  Is it?  "), ["SUPPORTS", "NOT_ENOUGH_INFO"], {"SUPPORTS": ["A"], "NOT_ENOUGH_INFO": [" C"]}, F.lit(" seen \n")).alias("p"),
        P.evidence_block(F.array(F.struct(F.lit("T").alias("title"), F.lit("x").alias("text")), F.struct(F.lit("").alias("title"), F.lit("y").alias("text")))).alias("e"),
    ).first()
    assert row["p"] == "You are a fact verification model.\n\nEvidence:\nseen\n\nClaim:\nIs it?\n\nChoose the correct label:\nA. SUPPORTS\nC. NOT ENOUGH INFO\n\nAnswer:"
    assert row["e"] == "[1] Title: T\nx\n\n[2] y"
    with pytest.raises(Exception, match="blank"):
        spark.range(1).select(P.claim_prompt(F.lit(" 　"), ["SUPPORTS"], P.VERBALIZERS)).collect()


def test_selector_input_keeps_last_four(spark):
    docs = F.array(*(F.struct(F.lit(None).cast("string").alias("title"), F.lit(f"d{i}").alias("text")) for i in range(6)))
    text = spark.range(1).select(P.selector_input(F.lit("q"), docs[0], docs)).first()[0]
    assert "[1] d2\n[2] d3\n[3] d4\n[4] d5" in text
    none = spark.range(1).select(P.selector_input(F.lit("q"), docs[0], F.slice(docs, 1, 0))).first()[0]
    assert "Already selected evidence:\nNone\n" in none


def test_distributions(spark):
    rows = spark.createDataFrame([([0.5, 0.5],), ([0.7, 0.2],), ([],), ([float("nan"), 1.0],), (None,)], "p array<double>")
    assert [r[0] for r in rows.select(V.is_distribution(F.col("p"))).collect()] == [True, False, False, False, False]
    logits = [1.0, -2.0, 700.0, 0.5]
    got = spark.createDataFrame([(logits,)], "l array<double>").select(V.posterior_from_logits(F.col("l"), [[0, 1], [2], [3]])).first()[0]
    assert sum(got) == pytest.approx(1) and got[1] == pytest.approx(1)


def test_posteriors_in_order(spark):
    cands = [{"doc_id": f"d{i}", "rank": i + 1, "score": 1.0, "title": None, "text": f"text {i}"} for i in range(4)]
    df = spark.createDataFrame([("a", "claim", "SUPPORTS", "test", cands), ("b", "other", "SUPPORTS", "test", [])], "id string, query string, label string, split string, candidates array<struct<doc_id:string,rank:int,score:double,title:string,text:string>>")
    rows = {r["id"]: r for r in posterior.score_posteriors(df, digest_scorer, ["SUPPORTS", "REFUTES"], P.VERBALIZERS, max_candidates=3, batch_size=2).collect()}
    assert [c["doc_id"] for c in rows["a"]["candidates"]] == ["d0", "d1", "d2"] and rows["b"]["candidates"] == []
    prompt = "You are a fact verification model.\n\nEvidence:\ntext 1\n\nClaim:\nclaim\n\nChoose the correct label:\nA. SUPPORTS\nB. REFUTES\n\nAnswer:"
    assert rows["a"]["candidates"][1]["eta"] == pytest.approx(digest_scorer()([prompt])[0].tolist())
    with pytest.raises(Exception, match="distribution"):
        posterior.score_posteriors(df, lambda: lambda p: np.ones((len(p), 2)), ["SUPPORTS", "REFUTES"], P.VERBALIZERS).collect()
