"""Fitting samples hold one row of each id, however often the id is repeated."""

from gleanery.llm import language, quality


def test_quality_sample(spark, monkeypatch):
    docs = [(i, f"text {i}") for i in range(60)] + [(7, f"more of seven {i}") for i in range(500)]
    labels = [(i, i % 2) for i in range(60)] + [(8, 0)] * 300
    got = []
    monkeypatch.setattr(quality, "fit_model", lambda rows, weight=None: got.extend(rows))
    quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 30 < len(got) <= 60 and len(got) == len(set(got))
    monkeypatch.setattr(quality, "PER_CLASS", 9)
    got.clear()
    quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert sorted(y for _, y in got) == [0] * 9 + [1] * 9


def test_language_sample(spark, monkeypatch):
    rows = [(i, f"some words {i}", "en") for i in range(200)] + [(i, f"ein paar {i}", "de") for i in range(200, 230)]
    rows += [(3, f"again {i}", "en") for i in range(900)] + [(4, "12", "en"), (5, None, "en"), (205, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    monkeypatch.setattr(language, "Model", lambda texts, langs: got.extend(zip(texts, langs, strict=True)))
    language.train(docs)
    assert sum(t.startswith("again") for t, _ in got) <= 1
    assert {v for _, v in got} == {"en", "de"} and 100 < len(got) <= 230
    monkeypatch.setattr(language, "PER_LANGUAGE", 10)
    assert language.sample(docs).count() <= 20
