"""SimHash by tries against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from gleanery.llm import simhash

DDL = "doc_id long, text string, print string, node int, root string, least long"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """fingerprint of each id -> smallest id reachable; ids may be null."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    return [top(p) for p in prints]


def least(rows):
    tops = plain_components([p for _, p in rows])
    low = {}
    for (d, _), t in zip(rows, tops, strict=True):
        if d is not None:
            low[t] = min(d, low.get(t, d))
    return sorted(((d is None, d, f"{p:016x}", low.get(t)) for (d, p), t in zip(rows, tops, strict=True)), key=str)


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéÀ") for _ in range(rng.randint(1, 4)))
    out = [None, "", " \t\n", "One", "one", "one TWO", "a\x0bb\x0cc", "a\x1cb c\x85d e", "nbsp\xa0stays one word", "x " * 40000]
    for _ in range(6):
        w = [word() for _ in range(400)]
        out.append(" ".join(w))
        for _ in range(4):
            v = list(w)
            v[rng.randrange(400)] = word()
            out.append("\n".join(v))
    return out


def test_fingerprint():
    for t in texts():
        for piece in (1, 7, 1 << 20):
            assert simhash.fingerprint((t or "").encode(), piece=piece) == plain_fingerprint(t)


def test_runs_cover_all_bits():
    for path in [(0,), (2,), (1, 2), (0, 0, 0, 0, 0), (2, 1, 0, 2)]:
        order, depth = simhash.order_of(path)
        assert sorted(order) == list(range(64)) and 0 < depth < 64
    assert 64 - simhash.order_of((0,) * 5)[1] <= 12


def test_trie_pairs():
    rng = random.Random(2)
    keys = sorted({rng.getrandbits(8) | rng.getrandbits(2) << 62 for _ in range(300)})
    groups = [0, 40, 41, 41, len(keys)]  # as if two groups and an empty one
    i, j = simhash.trie_pairs(np.array(keys, np.uint64), np.array(groups), 0)
    want = {(a, b) for g, h in zip(groups, groups[1:], strict=False) for a in range(g, h) for b in range(a + 1, h) if (keys[a] ^ keys[b]).bit_count() <= 2}
    got = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("node", [2, 5, 4096])
def test_near_prints(spark, node):
    """A dense cluster, chains of two-bit steps and scattered fingerprints; small nodes force deeper tries."""
    rng = random.Random(node)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for _ in range(3):
        now = rng.getrandbits(64)
        for _ in range(30):
            now ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(now)
    center = rng.getrandbits(64)
    prints |= {center ^ x for x in range(32)} | {center ^ 7 << 40 ^ x << 20 for x in range(16)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from gleanery.llm.components import components

    links = simhash.near_prints(spark.createDataFrame([(p,) for p in signed], "print long"), node=node)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    tops = dict(zip(prints, plain_components(list(prints)), strict=True))
    for p in prints:
        for q in prints:
            s, t = (x - (1 << 64) if x >> 63 else x for x in (p, q))
            assert (root.get(s, s) == root.get(t, t)) == (tops[p] == tops[q])


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[10], rows[10], (None, rows[11][1]), (None, "alone without an id"), (-5, rows[12][1])]
    df = spark.createDataFrame([(d, t, "mine", 1, "x", 7) for d, t in rows], DDL).repartition(3)
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r[0] is None, r[0], r[1], r[2]) for r in got.collect()), key=str)
    assert got == least([(d, plain_fingerprint(t)) for d, t in rows])
    assert simhash.near_duplicates(df.limit(0)).collect() == []
