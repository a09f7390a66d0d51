"""Claims, corpus, ordinals, JSON lines."""

import json

import pytest

from gleanery.operators import claims, corpus
from gleanery.sources import jsonl

MAP = {"SUPPORTS": "SUPPORTS", "REFUTES": "REFUTES"}
DROP = ["NOT ENOUGH INFO"]
SCHEMA = "id long, claim string, label string"


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows))
    return str(path)


def test_claims_from_json(spark, tmp_path):
    rows = [
        {"id": 1, "claim": "a", "label": "SUPPORTS"},
        "   ",
        {"id": 2, "label": "SUPPORTS"},
        {"id": 3, "claim": "c", "label": "NOT ENOUGH INFO"},
        {"id": 4, "claim": "d"},
        {"id": 5, "claim": "é", "label": None},
        {"id": 6, "claim": "f", "label": "ODD"},
        {"id": 7, "claim": "g", "label": "REFUTES"},
    ]
    raw = jsonl.read_jsonl(spark, write(tmp_path / "a.jsonl", rows), SCHEMA)
    got = [tuple(r) for r in claims.prepare_claims(raw, "fever2", "train", MAP, DROP).select("id", "query", "label").orderBy("id").collect()]
    assert got == [("fever2_train_00000001", "a", "SUPPORTS"), ("fever2_train_00000002", "é", None), ("fever2_train_00000003", "g", "REFUTES")]
    assert tuple(claims.claim_stats(raw, "train", MAP, DROP).first()) == (7, 3, 1, 3)
    assert tuple(claims.claim_stats(raw, "test", MAP, DROP).first()) == (7, 4, 1, 2)
    assert tuple(claims.claim_stats(raw, "train", MAP, DROP, limit=2).first()) == (2, 1, 0, 1)
    assert claims.claim_stats(raw, "train", MAP | {"NOT ENOUGH INFO": "NOT_ENOUGH_INFO"}, []).first()["kept"] == 4


def test_bad_json_fails(spark, tmp_path):
    for bad in ("{oops", "[1]"):
        with pytest.raises(Exception):
            jsonl.read_jsonl(spark, write(tmp_path / f"{len(bad)}.jsonl", [bad]), SCHEMA).collect()


def test_required_keys(spark, tmp_path):
    raw = jsonl.read_jsonl(spark, write(tmp_path / "a.jsonl", [{"id": 1, "claim": None}]), SCHEMA)
    assert jsonl.require_keys(raw, ["id", "claim"], "row").count() == 1
    with pytest.raises(Exception, match="label"):
        jsonl.require_keys(raw, ["label"], "row").collect()
    with pytest.raises(ValueError):
        jsonl.require_columns(raw, ["nothing"], "table")


def test_jsonl_round_trip_and_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("b", "a"):
        write(folder / f"{name}.jsonl", [{"id": i, "claim": f"{name}{i}", "label": None} for i in range(3)])
    rows = jsonl.read_jsonl(spark, str(folder), SCHEMA, recursive=True).orderBy("ord").collect()
    assert [r["claim"] for r in rows] == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert [r["ord"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert jsonl.read_jsonl(spark, str(folder), SCHEMA, limit=4, recursive=True).count() == 4
    df = spark.createDataFrame([(1, None), (2, "ü")], "id long, label string")
    assert jsonl.write_jsonl(df, str(tmp_path / "out")) == 2
    text = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text == ['{"id":1,"label":null}', '{"id":2,"label":"ü"}']


def test_resume(spark):
    src = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(2,)], "id long")
    assert sorted(r["id"] for r in jsonl.resume(src, done).collect()) == [1, 3]
    with pytest.raises(ValueError):
        jsonl.resume(src, spark.createDataFrame([(9,)], "id long"))
    with pytest.raises(ValueError):
        jsonl.resume(src, spark.createDataFrame([(2,), (2,)], "id long"))


PAGES = [
    (1, "Barack_Obama", "", "0\tBarack Obama was born.\t\n1\tHe served.\t\n"),
    (2, "Blank", "whole text", "  \n"),
    (3, "Short", "unused text", "0\tab\n1\tc"),
    (4, "", "x", "0\tsome sentence"),
    (5, None, "x", "0\tsome sentence"),
    (6, "Breaks", "", "bad line without tabs\r\n 3 \tthird one +4\t　wide blanks　\n1.5\tfraction line"),
]


def test_sentence_corpus(spark):
    pages = spark.createDataFrame(PAGES, "ord long, id string, text string, lines string")
    rows = [(r["doc_id"], r["title"], r["text"]) for r in corpus.sentence_corpus(pages, 5).orderBy("doc_id").collect()]
    assert rows == [
        ("feverwiki_00000001_sent_0000", "Barack_Obama", "Barack Obama was born."),
        ("feverwiki_00000002_sent_0001", "Barack_Obama", "He served."),
        ("feverwiki_00000003_sent_0000", "Blank", "whole text"),
        ("feverwiki_00000004_sent_0000", "Breaks", "bad line without tabs"),
        ("feverwiki_00000005_sent_0003", "Breaks", "third one"),
        ("feverwiki_00000006_sent_0004", "Breaks", "wide blanks"),
        ("feverwiki_00000007_sent_0003", "Breaks", "fraction line"),
    ]
    assert tuple(corpus.corpus_stats(pages, 5).first()) == (6, 7, 5)
    assert tuple(corpus.corpus_stats(pages, 5, limit_pages=2).first()) == (2, 3, 0)


def test_flat_evidence(spark):
    flat = spark.createDataFrame(
        [(1, "7", "SUPPORTS", "c7", "u", "0", "1", "2"), (2, "8", "NOT ENOUGH INFO", "c8", "u", "0", "1", "2"), (3, "7", "REFUTES", "other", "u", "0", "1", "2"), (4, "7", "SUPPORTS", "c7", "", "3", "x", "2"), (5, "zz", "SUPPORTS", "bad", "u", "-1", "1", "1")],
        "ord long, id string, label string, claim string, evidence_wiki_url string, evidence_sentence_id string, evidence_annotation_id string, evidence_id string",
    )
    got = {r["id"]: (r["label"], r["claim"], [tuple(e) for e in r["evidence"][0]]) for r in claims.claims_from_flat_evidence(flat).collect()}
    assert got[7] == ("SUPPORTS", "c7", [(1, 2, "u", 0), (-1, 2, None, None)])
    assert got[8][2] == [(1, 2, None, None)] and got[-1][2] == [(1, 1, None, None)]
    assert {r["id"] for r in claims.claims_from_flat_evidence(flat, limit=1).collect()} == {7}
    assert {r["id"] for r in claims.claims_from_flat_evidence(flat, limit=0).collect()} == set()


def test_nested_folders(spark, tmp_path):
    """Files of equal names; folders come before longer names that only look earlier."""
    for k, folder in enumerate(("a", "a-b", "a/c", "b")):
        (tmp_path / folder).mkdir(parents=True)
        write(tmp_path / folder / "x.jsonl", [{"id": 10 * k + i, "claim": None, "label": "é"} for i in range(3)] + ["  "])
    rows = jsonl.read_jsonl(spark, str(tmp_path), SCHEMA, recursive=True).orderBy("ord").collect()
    assert [r["id"] for r in rows] == [20, 21, 22, 0, 1, 2, 10, 11, 12, 30, 31, 32]
    assert [r["ord"] for r in rows] == list(range(1, 13))


def test_one_document(spark, tmp_path):
    df = spark.createDataFrame([(1, None, {"a": 2})], "n int, nothing string, counts map<string,int>")
    jsonl.write_document(df, str(tmp_path / "m"))
    jsonl.write_document(df, str(tmp_path / "m"))  # again: one document still
    files = [f for f in (tmp_path / "m").iterdir() if f.suffix == ".json"]
    assert len(files) == 1 and json.loads(files[0].read_text()) == {"n": 1, "nothing": None, "counts": {"a": 2}}


def test_evidence_recall(spark):
    from gleanery.operators import bm25

    cand = lambda p, s, r: {"page_id": p, "sentence_id": s, "rank": r}
    found = spark.createDataFrame([(1, [cand("p", 0, 1), cand("q", 1, 2), cand("p", 0, 3)]), (2, []), (3, [cand("p", 9, 1)])], "id long, candidates array<struct<page_id:string,sentence_id:int,rank:int>>")
    gold = spark.createDataFrame([(1, "p", 0), (1, "p", 0), (1, "q", 1), (1, "z", 5), (2, "p", 0), (3, None, None), (4, "p", 1)], "id long, page_id string, sentence_id int")
    rows = bm25.evidence_recall(found, gold)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 3, 2, 1), (2, 1, 0, None), (4, 1, 0, None)]
    assert tuple(bm25.recall_summary(rows).first()) == (3, 5, 2, 1, 0, pytest.approx(2 / 9))
    assert bm25.evidence_recall(found, gold, upto=1).where("id = 1").first()["found"] == 1
