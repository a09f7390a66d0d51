"""The pipeline against a plain rerun of its stages."""

import hashlib
import random
from collections import Counter

import pytest

from gleanery.llm import bpe, decontaminate, quality
from gleanery.llm.shingles import shingle_sets
from gleanery.llm.vocabulary import default_path

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice("river stone house green walk sunny field bird tree cloud".split()) + rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY!!", "NOW$$$", "###", "click&&&", "***"]) + str(rng.randint(0, 99)) for _ in range(n))
    rows, labels = [], []
    passage = prose(80)
    item = prose(15)
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, junk(90) if bad else prose(rng.randint(30, 120)), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(200 + i, f"{prose(10)} {passage} {prose(10)}", "en", "s", 0) for i in range(4)]
    rows += [(300, rows[1][1], "en", "s", 0), (301, rows[2][1] + " more", "en", "s", 0), (302, f"{prose(9)} {item} {prose(9)}", "en", "s", 0), (303, None, "en", "s", 0), (304, "", "en", "s", 0), rows[5]]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, item


def test_pipeline_equals_plain_stages(spark, folder):
    path, rows, item = folder
    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    now = [(d, t) for d, t, *_ in rows if model.score((t or "").encode()) >= quality.ACCEPT]
    assert 100 < len(now) < len(rows) - 30
    sets = [set(s.tolist()) for s in shingle_sets([(t or "").encode() for _, t in now])]
    up = list(range(len(now)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    best = {}
    for i, (d, t) in enumerate(now):
        best.setdefault(top(i), (d, t))
        best[top(i)] = min(best[top(i)], (d, t), key=lambda x: x[0])
    now = list(best.values())
    seen = Counter((t or "").encode()[i : i + 400] for _, t in now for i in range(len((t or "").encode()) - 399))
    cut = []
    for d, t in now:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                mark[i : i + 400] = b"\x01" * 400
        cut.append((d, bytes(c for c, m in zip(raw, mark, strict=True) if not m).decode()))
    index = decontaminate.Index([("1", item.encode())])
    clean = [(d, t) for d, t in cut if not index.search([t.encode()])[0][1]]
    assert len(clean) < len(cut)
    codec = bpe.codec(default_path())
    want = sorted((d, len(codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean)
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in pipeline.run(spark, path).collect())
    assert got == want


NAMES = ["_nth", "_row_a", "row_a", "row_b", "_text_a", "text_a", "_repeated", "repeated", "passages", "score", "spans", "doc", "nth", "once", "items", "n_words", "class", "_"]


def test_stages_keep_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: pipeline.F.lit(n) for n in NAMES})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert all(r[n] == n for r in out.select(*NAMES).limit(20).collect() for n in NAMES)
        assert stage(spark, docs.limit(0), path).count() == 0
