"""Operators on small tables with nulls, empty and long texts, repeats and ties, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import bpe, chat, decontaminate, jaccard, language, media, quality, repeats, shards, token_counts
from gleanery.llm.components import components
from gleanery.llm.queries import oracle_sql, queries
from gleanery.llm.shingles import shingle_sets
from gleanery.llm.vocabulary import default_path

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(150)
    base = prose(120)
    texts = [None, "", "   \n", "one", "two words", base, base, base.upper(), base + " tail", "head " + base, prose(10), "x " * 900, "ab" * 700, passage]
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(5)] + [prose(rng.randint(3, 200)) for _ in range(10)] + [base[: len(base) // 2], "<|endoftext|> " + prose(5), prose(6000)]
    for _ in range(12):  # near copies of one text, some of them only of each other
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[0], (None, "text without an id", "en", "s", 0), (None, base, "de", "s", 0)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    # Names that operators use inside, as extra columns.
    df = spark.createDataFrame(ROWS, DDL)
    for c in ("cell", "class", "row_a", "content", "core", "shard", "tokens", "spans", "score", "n_words", "media", "hub", "term"):
        df = df.withColumn(c, F.lit("mine"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(r):
    return tuple(-1 if v is None else v for v in r)


def texts_of():
    return [(d, "" if t is None else t) for d, t, *_ in ROWS]


def test_media(docs, none):
    got = sorted((key((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"])) for r in media.media_features(docs).collect()))
    want = []
    for d, t in texts_of():
        p = media._pad(t.encode())
        want.append(key((d, len(t.encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p))))
    assert got == sorted(want) and media.media_features(none).count() == 0
    kept = media.encode_media(docs.select("doc_id", "text", "media").withColumnRenamed("media", "other"))
    assert kept.columns == ["doc_id", "media", "other"]
    bad = media.read_media(kept.withColumn("media", F.lit(b"junk"))).first()
    assert bad["width"] is None and bad["error"]


def test_token_counts(spark, docs, none):
    path, cache = default_path(), token_counts.new_cache(spark)
    first = sorted(map(key, token_counts.token_counts(docs, path, cache=cache).collect()))
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == len({t for _, t in texts_of()})
    again = sorted(map(key, token_counts.token_counts(docs, path, cache=cache).collect()))
    assert first == again and spark.read.parquet(cache).count() == n
    extra = docs.limit(1).withColumn("text", F.lit("only here"))
    token_counts.token_counts(extra, path, cache=cache).collect()
    assert spark.read.parquet(cache).count() == n + 1
    c = bpe.codec(path)
    assert first == sorted(key((d, len(t.encode()), len(c.encode(t)), len(c.encode(t)) > 512)) for d, t in texts_of())
    assert token_counts.token_counts(none, path).count() == 0
    assert token_counts.read_cache(spark, cache, "another version").count() == 0


def test_bpe(docs, none):
    path = default_path()
    rows = sorted(key((r["doc_id"], r["decoded_sha256"])) for r in bpe.round_trip(docs, path).collect())
    assert rows == sorted(key((d, hashlib.sha256(t.encode()).hexdigest())) for d, t in texts_of())
    both = bpe.decode_column(bpe.encode_column(docs, path), path)
    assert both.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).count() == 0
    assert bpe.round_trip(none, path).count() == 0


ITEMS = [(1, "one two three"), (2, None), (3, ""), (10, None)]


def test_decontamination(spark, docs, none):
    long = [t for _, t in texts_of() if t.startswith("x ") is False and len(t.split()) > 100]
    items = spark.createDataFrame([(1, "two WORDS"), (2, None), (3, " ".join(long[0].split()[5:30])), (4, " ".join(long[0].split()[5:30])), (30, "not there at all whatever you look for in these few words"), (1, "two WORDS")], "item_id long, text string")
    want = sorted(map(key, decontaminate.contamination(docs, items).collect()))
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert sorted(map(key, decontaminate.contamination(docs, items, max_block_bytes=40).collect())) == want
    assert all(r["n_items"] == 0 for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.contamination(none, items).count() == 0


def test_chat(spark):
    ddl = "conv_id long, turn long, role string, text string"
    big = [(5, i, "user" if i % 2 else "assistant", f"t{i} <|im_end|>") for i in range(300)]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "<\\|"), (None, 0, "assistant", "x"), (2**60 + 1, 0, "assistant", "é"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), *big]
    got = {r["conv_id"]: r for r in chat.conversation_digests(spark.createDataFrame(rows, ddl).repartition(4)).collect()}
    assert set(got) == {1, 2, None, 2**60 + 1, 3, 5}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[2]["turns_sha256"] == sha("\n<\\|\n") and got[2]["loss_chars"] == 0
    assert got[3]["n_turns"] == 2 and got[3]["loss_sha256"] == sha("samesame")
    assert got[5]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in big))
    assert chat.conversation_digests(spark.createDataFrame([], ddl)).count() == 0


def test_shards(docs, none):
    rows = shards.shard_documents(docs, 4).collect()
    assert len(rows) == len(ROWS)
    slots, load, home = {}, Counter(), {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
        home.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values()) and set(slots) <= set(range(4))
    assert sum(load.values()) == sum(len(t.encode()) + 8 for _, t in texts_of())
    assert sorted(key((r["doc_id"], r["text_crc32"])) for r in rows) == sorted(key((d, zlib.crc32(t.encode()))) for d, t in texts_of())
    assert shards.shard_documents(none).count() == 0


@pytest.mark.parametrize("most", [400, 1])
def test_repeats(docs, none, most):
    cutter = repeats.Cutter(40, 10, 16)
    seen = Counter(t.encode()[i : i + 40] for _, t in texts_of() for i in range(len(t.encode()) - 39))
    want = []
    for d, t in texts_of():
        raw = t.encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - 39):
            if seen[raw[i : i + 40]] > 1:
                mark[i : i + 40] = b"\x01" * 40
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        want.append(key((d, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())))
    got = repeats.repeat_digests(docs, cutter=cutter, bits=16, most=most).collect()
    assert sorted(map(key, got)) == sorted(want)
    if most == 1:
        assert repeats.repeat_digests(none, cutter=cutter, bits=16).count() == 0
        cut = repeats.remove_repeats(docs, cutter=cutter, bits=16)
        assert cut.columns == docs.columns and cut.count() == len(ROWS)


@pytest.mark.parametrize("options", [{}, {"cell": 3, "rounds": 1}])
def test_jaccard(docs, none, options):
    sets = [(d, set(s.tolist())) for (d, t), s in zip(texts_of(), shingle_sets([t.encode() for _, t in texts_of()]), strict=True)]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = top(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(key((d, len(s), least[top(i)])) for i, (d, s) in enumerate(sets))
    assert len({top(i) for i in range(len(sets))}) < len(sets) - 6
    assert sorted(map(key, jaccard.near_duplicates(docs, **options).collect())) == want
    if options:
        return
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.one_of_each_component(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {w for w in least.values()}
    empty = sum(not s for _, s in sets)
    assert kept.count() == empty + len({top(i) for i, (_, s) in enumerate(sets) if s})
    assert jaccard.one_of_each_component(none).count() == 0


@pytest.mark.parametrize("options", [{"cell": 8}, {"cell": 5, "rounds": 0}])
def test_jaccard_many_near_copies(spark, options):
    """Groups of copies of copies, about as similar as the threshold asks."""
    rng = random.Random(14)
    word = lambda: f"{rng.choice('abcdefghij')}{rng.randint(0, 400)}"
    texts = []
    for size in (60, 45):
        base = [word() for _ in range(rng.randint(60, 90))]
        for _ in range(size):
            w = list(rng.choice(texts).split()) if texts and rng.random() < 0.4 else list(base)
            for _ in range(rng.randint(1, 4)):
                if rng.random() < 0.5:
                    w[rng.randrange(len(w))] = word()
                else:
                    w[rng.randrange(len(w)) :][:3] = []
                    w = w[: len(w) - rng.randint(0, 2)]
            texts.append(" ".join(w))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = list(range(len(sets)))
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert 10 < len(set(label)) < 90
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs, **options).collect())
    assert got == [(i, len(s), label[i]) for i, s in enumerate(sets)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 150), rng.randrange(100, 150)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    for a, b in edges:
        if a is not None:
            assert got[a] == got[b] <= a
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_and_language_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.quality_scores(none, labels.limit(0)).count() == 0
    found = language.languages(docs).collect()
    for r, (_, t) in ((r, t) for r in found for t in texts_of() if r["doc_id"] == t[0] and r["doc_id"] is not None):
        assert (r["lang_pred"] == "und") == (not language.has_letter(t))
    assert {r["lang_pred"] for r in found} == {"und", "en"}
    assert language.languages(none).count() == 0


def test_language_held_out(spark):
    rng = random.Random(9)
    vocab = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "nicht", "schön"], "fr": ["le", "avec", "être", "ça"], "es": ["el", "con", "niño", "ción"], "xx": ["zzq", "qqz"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(12)), k, "s", 0) for i in range(600) for k in [rng.choice(list(vocab))]]
    got = {r["doc_id"]: r for r in language.languages(spark.createDataFrame(rows, DDL)).collect()}
    held = [(got[i]["lang_pred"], k) for i, _, k, *_ in rows if got[i]["held_out"]]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)


CLASHES = ["media", "n_bytes", "n_tokens", "content", "ids", "decoded", "score", "lang_pred", "shard", "own", "weight", "group", "bytes", "cell", "doc", "_a", "_group", "spans", "items", "n_words", "text_a", "text_b", "_text_a", "passages", "_nth", "_row_a", "row_a", "row_b", "nth", "once"]


def test_no_column_is_touched(spark):
    """Every internal and result name as an extra column of every function that keeps columns."""
    path = default_path()
    rows = [(i, f"words of text number {i} and some more {i * 7}", "en") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in CLASHES})
    items = spark.createDataFrame([(1, "number 3 and some"), (2, "nothing here")], "item_id long, text string")
    model = language.Model(["a b", "c d"], ["en", "de"])
    made = {
        "media": (media.encode_media(df), {"media"}),
        "read": (media.read_media(media.encode_media(df)), {"n_bytes", "media"}),
        "tokens": (token_counts.count_tokens(df, path, token_counts.new_cache(spark)), {"n_bytes", "n_tokens"}),
        "bpe": (bpe.decode_column(bpe.encode_column(df, path), path), {"ids", "decoded"}),
        "quality": (quality.score_column(df, quality.fit_model([])), {"score"}),
        "language": (language.language_columns(df, model), {"lang_pred", "score"}),
        "shards": (shards.assign_shards(df, F.xxhash64("text"), F.octet_length("text").cast("long"), 3), {"shard"}),
        "items": (decontaminate.search_items(df, items), {"spans", "items", "n_words"}),
        "blocks": (decontaminate.search_items(df, items, max_block_bytes=10), {"spans", "items", "n_words"}),
        "jaccard": (jaccard.one_of_each_component(df), set()),
        "spans": (repeats.with_spans(df, bits=12), {"spans"}),
        "repeats": (repeats.remove_repeats(df, bits=12), set()),
    }
    for name, (out, results) in made.items():
        assert len(set(out.columns)) == len(out.columns), name
        kept = [c for c in CLASHES if c not in results]
        got = out.select("doc_id", *kept).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(12)), name
        assert all(r[c] == c for r in got for c in kept), name
        assert not any(r[c] == c for r in out.select(*(results & set(out.columns)), "doc_id").collect() for c in results & set(out.columns)), name


def test_registered():
    assert sorted(n.split("_")[0] for n in queries()) == sorted(f"op{i}" for i in range(1, 14))
    assert set(oracle_sql()) <= set(queries())
