"""Encoders, packers, matchers and suffix arrays on their own."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import bpe, chat, decontaminate, jaccard, language, media, quality, repeats, shards, token_counts
from gleanery.llm.shingles import shingle_sets
from gleanery.llm.suffixes import suffix_array
from gleanery.llm.vocabulary import default_path

TEXTS = ["", " ", "a", "Hello world's  end\n\n x", "é́퟿\U0001f600" * 20, "a<|endoftext|> b<|endoftext|>", "x y\x1cz ²½ 中文 \x85 \t\r\n", " " * 5000, "ab" * 3000, "'LL don't we'Ve 12345 ___ ...", "A" * 70000]


def test_media_round_trip():
    payloads = [media._pad(t.encode()) for t in TEXTS] + [bytes(range(256)) * 3]
    made = media.encode_payloads(payloads, [b"12345678"] * len(payloads))
    for p, (frames, thumbs) in zip(payloads, media.thumbnails(made), strict=True):
        assert b"".join(t.tobytes() for t in thumbs) == p and frames[0].width == 1536
    long = b"xyz " * (media.ROW * media.MAX_ROWS // 4 + 48)
    (frames, thumbs), = media.thumbnails(media.encode_payloads([long], [b""]))
    assert len(frames) == 2 and b"".join(t.tobytes() for t in thumbs) == long


def test_media_rejects_what_is_no_jpeg():
    good = media.encode_payloads([b" " * 192], [b""])[0]
    for bad in (None, b"", b"text", good[:-2], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        assert isinstance(media.thumbnails([bad])[0], str)


def test_colour_jpeg_with_subsampling():
    """A 4:2:0 image written by hand: luminance blocks come in MCU order, AC codes are skipped."""
    dc, ac = media._canonical({0: 2, 1: 2, 5: 2, 7: 3}), media._canonical({0x00: 1, 0x11: 3, 0xF0: 3})
    bits = ""
    put = lambda codes, s: f"{codes[s][0]:0{codes[s][1]}b}"
    previous, want = 0, np.zeros((4, 4), int)
    rng = random.Random(1)
    for mcu in range(4):
        for block in range(4):
            value = rng.choice([-100, -20, 0, 19, 90])
            y, x = (mcu // 2) * 2 + block // 2, (mcu % 2) * 2 + block % 2
            diff = value - previous
            while abs(diff).bit_length() not in (0, 1, 5, 7):
                value = rng.choice([-100, -20, 0, 19, 90, previous])
                diff = value - previous
            previous = value
            want[y, x] = value
            n = abs(diff).bit_length()
            bits += put(dc[1], n) + (f"{diff if diff >= 0 else diff + (1 << n) - 1:0{n}b}" if n else "")
            bits += put(ac[1], 0xF0) + put(ac[1], 0x11) + "1" + put(ac[1], 0)
        for _ in range(2):
            bits += put(dc[1], 0) + put(ac[1], 0)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([8]) * 64) + seg(0xC0, bytes((8, 0, 30, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)))
    head += seg(0xC4, b"\x00" + dc[0]) + seg(0xC4, b"\x10" + ac[0]) + seg(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0)))
    (frames, (thumb,)), = media.thumbnails([head + scan + b"\xff\xd9"])
    assert (frames[0].width, frames[0].height) == (30, 30)
    assert (thumb.astype(int) - 128 == want).all()


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = default_path()
    lib, own, count = Tokenizer.from_file(path), bpe.codec(path), token_counts._counter(path)
    odd = "".join(map(chr, [*range(0, 0x378), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]))
    for t in [*TEXTS[:-1], odd, " ".join(odd), "1".join(odd)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and count(t) == len(ids)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert own.decode([own.v.byte_ids[0xC3]]) == "�"


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        x = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_repeated_windows_against_brute_force():
    rng = random.Random(3)
    span = 8
    for _ in range(50):
        groups = []
        for _ in range(3):
            own = set()
            for i in range(rng.randint(1, 6)):
                low = rng.randint(0, span - 1)
                high = rng.randint(low, span - 1)
                own.add((low, high, bytes(rng.choice(b"ab") for _ in range(high + span - 1 - low))))
            groups.append([(i, *p) for i, p in enumerate(sorted(own))])
        got = repeats.repeated_windows(groups, span)
        for g, found in zip(groups, got, strict=True):
            seen = {}
            for i, low, high, e in g:
                for k in range(low, high + 1):
                    seen.setdefault((k, e[high - k : high + span - 1 - k]), []).append((i, k))
            want = {i: sorted(k for own in seen.values() if len(own) > 1 for j, k in own if j == i) for i, *_ in g}
            assert {i: sorted(ks) for i, ks in found} == want


def test_best_fit_decreasing():
    rng = random.Random(4)
    for most in (3, 20, 100):
        sizes = sorted((rng.randint(1, most) for _ in range(500)), reverse=True)
        got = [b for _, b, n in shards.best_fit(sorted(Counter(sizes).items(), reverse=True), 130) for _ in range(n)]
        room, want = [], []
        for s in sizes:
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            if fits:
                i = min(fits)[1]
            else:
                i = len(room)
                room.append(130)
            room[i] -= s
            want.append(i)
        assert got == want
    placed = shards.pack([*Counter(sizes).items(), (30_000, 1)], 24)
    assert sorted((s for s, _, n in placed for _ in range(n)), reverse=True) == [30_000, *sizes]
    load = [0] * 24
    for s, b, n in placed:
        load[b] += s * n
    rest = sorted(load)[:-1]
    assert max(load) == 30_000 and max(rest) - min(rest) <= 100
    assert shards.pack([], 24) == [] and shards.pack([(8, 3)], 24) == [(8, 0, 1), (8, 1, 1), (8, 2, 1)]


def test_wu_manber():
    rng = random.Random(5)
    words = [b"w%d" % i for i in range(6)]
    for _ in range(200):
        items = [(str(i), b" ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(5)]
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            text[3:3] = items[0][1].split()
        many = [b"", b" ".join(text), b"w1 " * 700]
        n, spans, found = decontaminate.Index(items, 4).search(many)[1]
        assert n == len(text)
        hit, named = set(), set()
        for name, t in items:
            w = t.split()
            n = min(4, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for j in range(len(text) - n + 1):
                    if text[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        named.add(name)
        assert {p for a, b in spans for p in range(a, b)} == hit and set(found) == named
    assert decontaminate.words_of("Aé_b 3\tÀ".encode()) == ["aé".encode(), b"b", b"3", "À".encode()]


def test_index_is_small():
    rng = random.Random(15)
    items = [(str(i), " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 9999)) for _ in range(60)).encode()) for i in range(10_000)]
    size = sum(len(t) for _, t in items)
    index = decontaminate.Index(items)
    assert size > 4_000_000 and index.nbytes < 5 * size
    [(n, spans, found)] = index.search([b"x y " + items[77][1] + b" z"])
    assert n == 63 and spans == [(2, 62)] and "77" in found


@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "<|im_start|>", "<\\n<\n", "x<\\\\|"])
def test_chat_round_trip(role):
    for text in ["", "plain", chat.PROBE, "<|", "<\\|", "<\\\\|x", "a<|im_end|>\n<|im_start|>user\nb", "<<|>\n", "\\<|\\"]:
        piece = chat.format_turn(role, text)
        assert [t[:2] for t in chat.parse(piece * 2)] == [(role, text)] * 2
    with pytest.raises(ValueError):
        chat.parse("loose text")


def test_shingles():
    def brute(t):
        w = bytes(c | 32 if 65 <= c <= 90 else c for c in t).split()
        return len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))

    texts = [t.encode() for t in TEXTS] + [b"a b c d e " * 9, b"A b\x0bc", b"a b c d E", b"A B C D e"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [brute(t) for t in texts]
    assert (sets[-1] == sets[-2]).all() and (shingle_sets([texts[-1]])[0] == sets[-1]).all()
    assert len(np.intersect1d(*shingle_sets([b"a b", b"b a"]))) == 0


def test_block_links():
    rng = np.random.default_rng(6)
    token = lambda k: np.unique(rng.integers(0, 1 << 48, k).astype(np.uint64))
    base = token(200)
    sets = [np.unique(np.concatenate([base[: 200 - k], token(k)])) for k in range(0, 60, 3)]
    seen, times = np.unique(np.concatenate(sets), return_counts=True)
    many = seen[times > 1]
    packed = []
    for s in sets:
        own = s[np.isin(s, many)]
        packed.append((len(s), own, jaccard.level(times[np.searchsorted(seen, own)])))
    got = jaccard.block_links(packed[:12], packed)
    for i, a in enumerate(sets[:12]):
        for j, b in enumerate(sets):
            if i == j:
                continue
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 80 * (len(a) + len(b) - both))
            assert (both >= jaccard.least_overlap(len(a), len(b))) == got[i, j]
    for keys in jaccard.order_keys(np.arange(100_000, dtype=np.uint64), np.full(100_000, 9, np.uint8)):
        assert len(np.unique(keys)) == 100_000


def test_packed_tokens():
    rng = np.random.default_rng(12)
    for n in (1, 3, 50_000):
        flat = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        for parts in (1, 7, 300):
            part = jaccard._part_of(flat, parts).astype(int)
            for p in set(part.tolist()):
                own, base = flat[part == p], jaccard.part_base(p, parts)
                assert own[0] >= base and (jaccard.undeltas(jaccard.deltas(own, base), len(own), base) == own).all()


def test_quality_model():
    rng = random.Random(7)
    good = lambda: (" ".join(rng.choice(["river", "stone", "house", "green", "walk"]) for _ in range(200)).encode(), 1)
    bad = lambda: (" ".join(rng.choice(["BUY!!", "NOW$$", "###", "click&&"]) for _ in range(200)).encode(), 0)
    model = quality.fit_model([f() for _ in range(150) for f in (good, bad)])
    assert all(model.score(good()[0]) > 0.5 > model.score(bad()[0]) for _ in range(20))
    assert 0 <= model.score(b"") <= 1 and quality.fit_model([]).score(b"x") == 0.5
    from zstandard import ZstdCompressionDict, ZstdCompressor

    pair = [ZstdCompressor(level=quality.LEVEL, dict_data=ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False) for raw in (model.good, model.bad)]
    for text in (good()[0], bad()[0], b"plain words " * 200, b"x"):  # the score from two plain dictionaries
        parts = quality.blocks(text)
        mean = sum((len(pair[0].compress(p)) - len(pair[1].compress(p))) / len(p) for p in parts) / len(parts)
        assert abs(model.score(text) - 1 / (1 + np.exp(-(model.slope * mean + model.shift)))) < 1e-9
    assert b"".join(quality.blocks(b"x" * 1234)) == b"x" * 1234 and quality.blocks(b"") == [b""]
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_language_margins():
    rng = random.Random(16)
    vocab = {"en": ["the", "and", "with"], "de": ["der", "und", "schön"], "fr": ["le", "être", "ça"], "es": ["el", "niño", "ción"]}
    langs = [rng.choice(list(vocab)) for _ in range(80)]
    texts = [" ".join(rng.choice(vocab[v]) for _ in range(9)) for v in langs]
    model = language.Model(texts, langs)
    some = [*texts[:20], "A", "ÉTÉ und the", "mixed der le el " * 50]
    want = language.features(some).astype(np.float64) @ model.weights + model.shifts
    assert np.allclose(model.margins(some), want, atol=1e-4)
    assert sum(p == v for (p, _), v in zip(model.predict(texts), langs, strict=True)) >= 76


def test_language_memory():
    """Neither many machines nor one very long text make large arrays; pieces and groups give what one count gives."""
    import tracemalloc

    model = language.Model([], [])
    model.weights, model.shifts = np.random.default_rng(1).normal(size=(language.BUCKETS, 300)).astype(np.float32), np.zeros(300)
    long = "Grüße an die Welt. " * 1_000_000  # 20 MB
    small = [f"text number {i}" for i in range(3000)]
    tracemalloc.start()
    far = model.margins([long])
    assert tracemalloc.get_traced_memory()[1] < 8 * len(long.encode())
    tracemalloc.reset_peak()
    near = model.margins(small)
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()
    assert np.allclose(near[130], model.margins([small[130]])[0], atol=1e-5)
    assert np.allclose(far[0], language.features([long])[0] @ model.weights, atol=1e-4)


def test_language_pieces(monkeypatch):
    text = "Ein Satz, der über mehrere Stücke geht; " * 40
    whole = language.features([text])
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.array_equal(language.features([text]), whole)
