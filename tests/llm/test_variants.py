"""Spelling variants through the gram index against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from gleanery.llm import variants

DDL = "doc_id long, text string, word string, n int, key string, form string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_forms(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=str)


def make_words(seed, letters, size):
    rng = random.Random(seed)
    n = {}
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        n[w] = rng.choice([2, 5, 40, 600, 7000])
        for _ in range(rng.randint(0, 6)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])
            if len(v) >= 7:
                n[v] = rng.choice([2, 3, 50, 900])
                w = rng.choice([w, v])
    return n


def test_affected_bound_holds():
    """No edit changes more grams than the bound says, and the bound leaves one gram at least."""
    words = list(make_words(3, "abé", 30))
    places = Counter(w[i : i + k] for w in words for k in (2, 3, 4) for i in range(len(w) - k + 1))
    for line in (1, 10, 200):
        frequent = {g for g, c in places.items() if c > line}
        for w in words:
            grams = variants.decompose(w, frequent)
            own, bound = Counter(w[i:j] for i, j in grams), variants.affected_bound(w, grams, frequent)
            assert len(grams) > bound
            for i in range(len(w) + 1):
                for v in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i:] for c in "abz"), *(w[:i] + c + w[i + 1 :] for c in "abz")} - {w}:
                    other = Counter(v[a:b] for a, b in variants.decompose(v, frequent))
                    assert sum((own - other).values()) <= bound


@pytest.mark.parametrize("letters,line,most", [("ab", 48, 200_000), ("abcdefghé", 1, 200_000), ("aaab", 2, 3), ("ab×ÿ", 5, 20)])
def test_forms(spark, letters, line, most):
    n = make_words(len(letters) + line, letters, 60)
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = sorted((tuple(r) for r in variants.spelling_forms(df, line=line, most=most).collect()), key=str)
    assert got == plain_forms(n)


def test_documents(spark):
    rng = random.Random(9)
    base = list(make_words(1, "abcdefg", 25))
    rows = [(i, " ".join(rng.choice(base[: 3 + i % 20]).capitalize() for _ in range(rng.randint(1, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "1234 -- short"), (None, "ÉCOLIÈRES écolières ÉCOLIÈRES " * 5), (103, "Straße×÷éàü " * 3000), rows[0], rows[0]]
    df = spark.createDataFrame([(d, t, "mine", 3, "k", "f") for d, t in rows], DDL).repartition(4)
    out = variants.spelling_variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_forms(plain_counts(rows))
    assert variants.spelling_variants(df.limit(0)).collect() == []


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        variants.near_words(spark.createDataFrame([("short", 3)], "word string, n long"))
