"""The pipeline's cut of repeated passages of more than 50 words, against brute force."""

import random
import re
from collections import Counter

import pytest

from gleanery.llm import repeats

pipeline = pytest.importorskip("corpus_pipeline")


def test_short_passages_are_cut(spark):
    rng = random.Random(33)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n))
    short = lambda n: " ".join(rng.choice(["at", "é", "in", "on", "to", "we", "A", "up"]) for _ in range(n))
    passage, fifty, cased, far = short(51), short(50), short(60), short(70)
    assert all(len(x.encode()) < 400 for x in (passage, fifty, cased, far))
    texts = [
        *(f"{prose(40)} {passage} {prose(25)}" for _ in range(3)),
        *(f"{prose(30)} {fifty} {prose(30)}" for _ in range(2)),
        f"{prose(20)} {cased}",
        f"{prose(20)} {cased.swapcase()}",
        f"{far}, {prose(30)}",
        f"{prose(30)}\n{far.replace(' ', chr(9), 9)}  {prose(9)}　{far}",
        passage,
        prose(300),
        "once " * 40,
        "again " * 60,
        None,
        "",
        *["same text of few words"] * 2,
    ]
    seen = Counter()
    words = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for t in texts]
    key = lambda raw, own: tuple(raw[a:b] for a, b in own)
    for t, own in zip(texts, words, strict=True):
        seen.update(key((t or "").encode(), own[i : i + 51]) for i in range(len(own) - 50))
    want = []
    for n, (t, own) in enumerate(zip(texts, words, strict=True)):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(own) - 50):
            if seen[key(raw, own[i : i + 51])] > 1:
                a, b = own[i][0], own[i + 50][1]
                mark[a:b] = b"\x01" * (b - a)
        want.append((n, t and bytes(c for c, m in zip(raw, mark, strict=True) if not m).decode()))
    docs = spark.createDataFrame([(n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in pipeline.suffix_array_dedup(spark, docs.repartition(3), "").collect())
    assert got == want
    digests = {r["doc_id"]: r for r in repeats.repeat_digests(docs, words=50).collect()}
    for n, (t, own) in enumerate(zip(texts, words, strict=True)):
        raw = [(t or "").encode()[a:b] for a, b in own]
        hit = {k for i in range(len(raw) - 50) if seen[tuple(raw[i : i + 51])] > 1 for k in range(i, i + 51)}
        assert digests[n]["n_passage_words"] == len(hit)
    # No passage has 400 bytes, so only what repeats itself loses bytes; 51 words are seen all the same.
    assert digests[0]["n_removed"] == 0 and digests[0]["n_passage_words"] == 51 and digests[3]["n_passage_words"] == 0
    out = dict(got)
    assert all(passage not in out[n] for n in (0, 1, 2)) and out[9] == "" and fifty in out[3] and cased in out[5]


def test_bytes_around_the_window(spark):
    """Passages of 399 to 403 bytes (with the bars around them) in two documents: removed from 400 bytes on, whatever their words."""
    rng = random.Random(41)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n))
    rows = []
    for n in (397, 398, 399, 400, 401):
        passage = prose(120)[:n]
        for side in (0, 1):
            rows.append((len(rows), f"{prose(20)}{side}|{passage}|{side + 2}{prose(20)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_digests(docs).collect()}
    for i, n in enumerate((397, 398, 399, 400, 401)):
        assert got[2 * i] == got[2 * i + 1] == (n + 2 if n + 2 >= 400 else 0)
