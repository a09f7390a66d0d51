"""Token alignment through incidence products against a plain walk over the bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import alignment
from gleanery.llm.vocabulary import printable_bytes

DDL = "doc_id long, text string, flush string, kind int, units string, a string, place int"
ODD = ["", None, " ", "  ", "   x", "x ", "x  ", "a  b", "a\n b", "a\n  b\t\t c \n", "\n", "<s> </s> <|endoftext|> <0x41>", "é▁x plain", "▁", "中文 字符 \U0001f600\U0001f600", "nbsp\xa0 b  c\x1c d\x85 e", "don't we'll  've", "1234 5678901 ...!?", "x" * 300, "ﬁ Ａ ² ½", "\x00 null", "tab\tand\r\nlines\r\n "]


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor

    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=path_b)
    raw = printable_bytes()

    def tokens(text):
        """(id, bytes) lists of A and B for the whole text; empty if the bytes differ."""
        if not text:
            return [], []
        own = [(i, bytes(raw[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            other.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (own, other) if b"".join(t for _, t in own) == want == b"".join(t for _, t in other) else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for _, t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def walk(a, b):
    """Links (i, j, bytes) and groups ([i...], [j...])."""
    x, y = spans(a), spans(b)
    links = [(i, j, min(e, f) - max(s, t)) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if min(e, f) > max(s, t)]
    ends, groups = sorted({e for _, e in x} & {f for _, f in y}), []
    low = 0
    for e in ends:
        groups.append(([i for i, (_, z) in enumerate(x) if low < z <= e], [j for j, (_, z) in enumerate(y) if low < z <= e]))
        low = e
    return links, groups


def expected(rows, plain):
    own = [(d, *plain(t)) for d, t in rows]
    count, walked = Counter(), []
    for _, a, b in own:
        links, groups = walk(a, b)
        walked.append((links, groups))
        count.update((a[i][0], b[j][0]) for i, j, _ in links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (d, a, b), (links, groups) in zip(own, walked, strict=True):
        ns = [(count[a[i][0], b[j][0]], best[b[j][0]]) for i, j, _ in links]
        text = ";".join(",".join(str(a[i][0]) for i in x) + "|" + ",".join(str(b[j][0]) for j in y) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(n == m for n, m in ns), sum(n for n, _ in ns), sum(len(x) * len(y) for x, y in groups), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def make_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghinorstué") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    texts = ODD + [rng.choice(["", " "]) + rng.choice([" ", "  ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = list(enumerate(texts))
    return [*rows, rows[-1], rows[-1], (None, rows[-2][1]), (None, None)]


def test_products():
    rng = np.random.default_rng(1)
    for n, k, m in [(1, 1, 1), (5, 7, 4), (0, 3, 2), (6, 0, 3), (9, 30, 8)]:
        x, y = rng.random((n, k)) < 0.3, rng.random((k, m)) < 0.3
        rows = lambda d: alignment.Rows(np.concatenate([[0], np.cumsum(d.sum(axis=1))]).astype(np.int64), np.nonzero(d)[1])
        want = x.astype(int) @ y.astype(int)
        i, j, v = rows(x).product(rows(y))
        got = np.zeros((n, m), int)
        got[i, j] = v
        assert (got == want).all() and len(i) == (want > 0).sum()
        assert rows(x).product_size(rows(y)).tolist() == want.sum(axis=1).tolist()
        i, j, v = rows(x).product(rows(y).transposed(m).transposed(k))
        assert len(i) == (want > 0).sum()


def test_units_join_to_the_whole(plain):
    t = alignment.tokenizers(*alignment.default_paths())
    for text in [x for x in ODD if x] + [r[1] for r in make_rows() if r[1]]:
        whole = t.a.encode(text), t.b.encode(text)
        parts = alignment.units(text)
        assert "".join(" " + p for p in parts) == " " + text
        assert [i for p in parts for i in t.a.encode(p)] == whole[0]
        assert [i for p in parts for i in t.b.encode(p)] == whole[1]
        e = t.encode(parts)
        if e.whole.all():
            assert (e.a.tolist(), e.b.tolist()) == whole
        assert e.n_a.tolist() == [len(t.a.encode(p)) * ok for p, ok in zip(parts, e.whole, strict=True)]


@pytest.mark.parametrize("flush", [1, 700, 1 << 20])
def test_digests(spark, plain, flush):
    rows = make_rows()
    df = spark.createDataFrame([(d, t, "mine", 5, "u", "a", 9) for d, t in rows], DDL).repartition(2)
    out = alignment.alignment_digests(df, *alignment.default_paths(), flush_bytes=flush)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(rows, plain)
    assert alignment.alignment_digests(df.limit(0), *alignment.default_paths()).collect() == []


def test_column(spark, plain):
    rows = make_rows()
    df = spark.createDataFrame([(d, t, "mine", 5, "u", "a", 9) for d, t in rows], DDL)
    out = alignment.alignment_column(df, *alignment.default_paths(), shared=True)
    assert out.columns == [*df.columns, "alignment"]
    for r in out.collect():
        a, b = plain(r["text"])
        links, groups = walk(a, b)
        x = r["alignment"]
        assert x["a"] == [i for i, _ in a] and x["b"] == [i for i, _ in b]
        assert [tuple(v) for v in x["links"]] == links
        assert [tuple(g) for g in x["groups"]] == [(i[-1] + 1, j[-1] + 1) for i, j in groups]
        assert [tuple(s) for s in x["shared"]] == sorted((i, j) for p, q in groups for i in p for j in q)
