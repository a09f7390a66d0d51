"""Media columns: baseline JPEG written from and read back into byte payloads.

The writer stores one payload byte as the DC coefficient of one flat 8x8 grey
block (quantiser 8, so the block's sample value *is* the byte).  The reader is a
general baseline decoder: it parses the markers, Huffman-decodes the scans and
rebuilds the DC-only luminance thumbnail (one sample a block) with numpy, also
for colour images with subsampling; AC coefficients are skipped over, which is
all a 1/8-scale thumbnail needs.  For stored payloads that thumbnail is the
payload.

Every restart interval is byte-aligned and independent, so the reader decodes
all intervals of a batch in lock step, one numpy lane each.

Defined results: null text counts as empty; an empty text becomes one row of
192 blanks; payloads over ``ROW * MAX_ROWS`` bytes become several JPEG images
behind one another; bytes that are no baseline JPEG give null dimensions and an
``error``.  Extra columns pass through untouched; only one that has a result
column's name gives way to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adder, slices, text_slices

ROW = 192  # blocks, and payload bytes, in a thumbnail row
MAX_ROWS = 8191  # 8 * 8191 lines is the most that a frame header can state
BATCH_BYTES = 2_000_000

# Fixed values of the written images: code lengths of the DC size classes 0..11
# (text differences are mostly of size 2 to 7) and one AC code, end of block.
DC_LENGTHS = {0: 4, 1: 4, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 4, 9: 6, 10: 6, 11: 6}
AC_LENGTHS = {0x00: 1}
# Fixed values of the format: zig-zag position is irrelevant here, marker codes are not.
SOI, EOI, SOS, DQT, DHT, DRI, COM, SOF0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xC0


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body (counts and symbols) and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == size for n in lengths.values()) for size in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(counts) + bytes(order), codes


_DC_BODY, _DC_CODES = _canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = _canonical(AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int, note: bytes) -> bytes:
    return b"".join(
        (
            bytes((0xFF, SOI)),
            _segment(COM, note),
            _segment(DQT, b"\x00" + bytes([8]) * 64),
            _segment(SOF0, bytes((8,)) + (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes((1, 1, 0x11, 0))),
            _segment(DHT, b"\x00" + _DC_BODY),
            _segment(DHT, b"\x10" + _AC_BODY),
            _segment(DRI, ROW.to_bytes(2, "big")),
            _segment(SOS, bytes((1, 1, 0x00, 0, 63, 0))),
        )
    )


@lru_cache(maxsize=1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: the bits of its block, left-aligned in 16, and their number."""
    value, length = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    eob, eob_len = _AC_CODES[0]
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _DC_CODES[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits = ((code << size | extra) << eob_len) | eob
        total = n + size + eob_len
        value[d + 255], length[d + 255] = bits << (16 - total), total
    return value, length


def encode_payloads(payloads: list[bytes], notes: list[bytes]) -> list[bytes]:
    """JPEG bytes of every payload; a payload's length is a positive multiple of ROW."""
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = flat.copy()
    diff[:, 1:] -= flat[:, :-1]
    value, length = _block_codes()
    index = diff + 255
    bits, n = value[index].astype(np.int64), length[index].astype(np.int64)
    bits >>= 16 - n
    for _ in range(2):  # join neighbours: four blocks a word, at most 52 bits
        bits = bits[:, ::2] << n[:, 1::2] | bits[:, 1::2]
        n = n[:, ::2] + n[:, 1::2]
    row_bits = n.sum(axis=1)
    row_bytes = (row_bits + 7) >> 3
    row_start = np.concatenate(([0], np.cumsum(row_bytes)))
    at = np.cumsum(n, axis=1) - n + row_start[:-1, None] * 8
    word = (bits << (64 - 7 - n)) << 7 - (at & 7)
    word = word.astype(">i8").view(np.uint8).reshape(-1, 8)
    packed = np.zeros(int(row_start[-1]) + 8, np.uint8)
    byte = (at >> 3).ravel()
    for k in range(8):  # words are longer than a byte, so one step writes no byte twice
        packed[byte + k] |= word[:, k]
    packed = packed[:-8]
    packed[row_start[1:] - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)
    stuffed = np.where(packed == 0xFF, 2, 1)
    per_row = np.add.reduceat(stuffed, row_start[:-1]) + 2
    scan = np.zeros(int(per_row.sum()), np.uint8)
    rows_end = np.cumsum(per_row)
    to = np.cumsum(stuffed) - stuffed + np.repeat(np.arange(len(per_row)) * 2, row_bytes)
    scan[to] = packed
    scan[rows_end - 2] = 0xFF
    made, row = [], 0
    frames = []
    for p in payloads:
        rows = len(p) // ROW
        frames.append([(row + a, min(a + MAX_ROWS, rows) - a) for a in range(0, rows, MAX_ROWS)])
        row += rows
    mark = np.empty(len(per_row), np.uint8)
    for own in frames:
        for first, rows in own:
            mark[first : first + rows] = 0xD0 + (np.arange(rows) & 7)
            mark[first + rows - 1] = EOI
    scan[rows_end - 1] = mark
    whole = scan.tobytes()
    starts = np.concatenate(([0], rows_end))
    for own, note in zip(frames, notes, strict=True):
        made.append(b"".join(_header(rows, note) + whole[starts[first] : starts[first + rows]] for first, rows in own))
    return made


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_SCAN_END = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


@lru_cache(maxsize=256)
def _lookup(body: bytes) -> np.ndarray:
    """16 peeked bits -> code length << 8 | symbol (0: no such code)."""
    table, code, at = np.zeros(65536, np.uint16), 0, 16
    for size in range(1, 17):
        for _ in range(body[size - 1]):
            low = code << (16 - size)
            table[low : low + (1 << (16 - size))] = size << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Frame:
    """One parsed baseline image: sizes, luminance layout, tables, intervals."""

    __slots__ = ("width", "height", "schedule", "profile", "luma_h", "luma_v", "quant", "mcus", "mcu_w", "intervals", "restart", "note")


def parse_markers(data: bytes) -> list[_Frame]:
    """All baseline images of ``data``; ValueError if it holds something else."""
    frames, at = [], 0
    while at < len(data):
        frame, at = _parse_one(data, at)
        frames.append(frame)
    if not frames:
        raise ValueError("no image")
    return frames


def _parse_one(data: bytes, at: int) -> tuple[_Frame, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI")
    at += 2
    quants, huffs, comps, out = {}, {}, {}, _Frame()
    out.restart, out.note = 0, b""
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("cut segment")
        at += 2 + size
        if marker == DQT:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quants[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                i += 1 + 64 * (1 + wide)
        elif marker == DHT:
            i = 0
            while i < len(body):
                n = 17 + sum(body[i + 1 : i + 17])
                huffs[body[i]] = body[i + 1 : i + n]
                i += n
        elif marker == DRI:
            out.restart = int.from_bytes(body, "big")
        elif marker == COM:
            out.note = body
        elif marker == SOF0 or marker == 0xC1:
            if body[0] != 8:
                raise ValueError("not 8-bit")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                c, hv, tq = body[6 + 3 * i : 9 + 3 * i]
                comps[c] = (hv >> 4, hv & 15, tq)
            if not out.height or not out.width or not comps:
                raise ValueError("no size")
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == SOS:
            break
        elif marker == EOI:
            raise ValueError("no scan")
    n = body[0]
    if n != len(comps):
        raise ValueError("scan is not interleaved")
    tables, out.schedule, names = [], [], {}
    for i in range(n):
        c, t = body[1 + 2 * i], body[2 + 2 * i]
        dc, ac = huffs[t >> 4], huffs[0x10 | (t & 15)]
        for x in (dc, ac):
            if x not in names:
                names[x] = len(tables)
                tables.append(x)
        h, v, tq = comps[c] if n > 1 else (1, 1, comps[c][2])
        if i == 0:
            out.luma_h, out.luma_v, out.quant = h, v, quants[tq]
        out.schedule += [(i, names[dc], names[ac])] * (h * v)
    hmax = max(h for h, _, _ in comps.values()) if n > 1 else 1
    vmax = max(v for _, v, _ in comps.values()) if n > 1 else 1
    out.mcu_w = -(-out.width // (8 * hmax))
    out.mcus = out.mcu_w * -(-out.height // (8 * vmax))
    out.profile = (tuple(tables), tuple(out.schedule))
    end = _SCAN_END.search(data, at)
    stop = end.start() if end else len(data)
    out.intervals = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:stop])]
    at = stop
    if data[at : at + 2] != b"\xff\xd9":
        raise ValueError("no EOI after the scan")
    return out, at + 2


def _decode_lanes(profile: tuple, lanes: list[bytes], mcus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised luminance DC values of every lane, one lane behind another; which lanes went wrong."""
    tables, schedule = profile
    lut = np.concatenate([_lookup(x) for x in tables]).astype(np.int64)
    comp = np.array([s[0] for s in schedule])
    dc_at = np.array([s[1] for s in schedule]) << 16
    ac_at = np.array([s[2] for s in schedule]) << 16
    luma = int((comp == 0).sum())
    pad = b"\xff" * 8
    sizes = np.fromiter(map(len, lanes), np.int64, len(lanes))
    b = np.frombuffer(pad.join(lanes) + pad, np.uint8).astype(np.int64)
    window = b[:-4] << 32
    for i in range(1, 5):
        window |= b[i : len(b) - 4 + i] << (32 - 8 * i)
    start = (np.cumsum(sizes + 8) - (sizes + 8)) * 8
    pos, limit = start.copy(), start + sizes * 8
    count = mcus * luma
    put = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    wrong = np.zeros(len(lanes), bool)
    live = np.flatnonzero(mcus > 0)
    pos, limit, put = pos[live], limit[live], put[live]
    left = mcus[live] * len(schedule)
    turn, k = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    pred = np.zeros((len(live), int(comp.max()) + 1), np.int64)
    single = len(schedule) == 1
    while len(live):
        w = window[np.minimum(pos >> 3, len(window) - 1)]
        is_dc = k == 0
        all_dc = is_dc.all()
        some_dc = all_dc or is_dc.any()
        if single:
            base = dc_at[0] if all_dc else ac_at[0] if not some_dc else np.where(is_dc, dc_at[0], ac_at[0])
        else:
            base = np.where(is_dc, dc_at[turn], ac_at[turn])
        room = 40 - (pos & 7)
        code = lut[base + ((w >> (room - 16)) & 0xFFFF)]
        n, symbol = code >> 8, code & 0xFF
        size = symbol & 15
        n_all = n + size
        pos += n_all
        bad = (n == 0) | (pos > limit)
        if some_dc:
            extra = (w >> (room - n_all)) & ((1 << size) - 1)
            at = slice(None) if all_dc else np.flatnonzero(is_dc)
            s, x = size[at], extra[at]
            step = np.where((x << 1) < (1 << s), x - (1 << s) + 1, x)
            if single:
                pred[at, 0] += step
                out[put[at]] = pred[at, 0]
                put[at] += 1
            else:
                at = np.flatnonzero(is_dc)
                c = comp[turn[at]]
                pred[at, c] += step
                first = at[c == 0]
                out[put[first]] = pred[first, 0]
                put[first] += 1
        if all_dc:
            k += 1
        else:
            run = symbol >> 4
            step = np.where(size == 0, np.where(run == 15, 16, 64), run + 1)
            k = np.where(is_dc, 1, k + step) if some_dc else k + step
            done = k >= 64
            k[done] = 0
            if not single:
                turn = np.where(done, turn + 1, turn)
                turn[turn == len(schedule)] = 0
            left -= done
        keep = (left > 0) & ~bad
        if not keep.all():
            wrong[live[bad]] = True
            live, pos, limit, put, left, turn, k, pred = (x[keep] for x in (live, pos, limit, put, left, turn, k, pred))
    return out, wrong


def thumbnails(items: list[bytes | None]) -> list[tuple[list[_Frame], list[np.ndarray]] | str]:
    """For each stored item: its frames and their DC-only luminance thumbnails, or what is wrong."""
    parsed: list = []
    for data in items:
        try:
            parsed.append(parse_markers(data or b""))
        except (ValueError, IndexError, KeyError) as e:
            parsed.append(f"not a baseline JPEG: {e}")
    jobs: dict[tuple, list] = {}
    for i, frames in enumerate(parsed):
        if not isinstance(frames, str):
            for j, f in enumerate(frames):
                per = f.restart or f.mcus
                if len(f.intervals) != -(-f.mcus // per):
                    parsed[i] = "not a baseline JPEG: restart intervals are missing"
                    break
                jobs.setdefault(f.profile, []).append((i, j, f, per))
    thumbs: dict[tuple[int, int], np.ndarray] = {}
    for profile, own in jobs.items():
        lanes, mcus = [], []
        for _, _, f, per in own:
            lanes += f.intervals
            mcus += [per] * (len(f.intervals) - 1) + [f.mcus - per * (len(f.intervals) - 1)]
        values, wrong = _decode_lanes(profile, lanes, np.array(mcus, np.int64))
        lane = at = 0
        for i, j, f, _ in own:
            if wrong[lane : lane + len(f.intervals)].any():
                parsed[i] = "not a baseline JPEG: damaged scan"
            lane += len(f.intervals)
            n = f.mcus * f.luma_h * f.luma_v
            dc = values[at : at + n]
            at += n
            grid = dc.reshape(-1, f.mcu_w, f.luma_v, f.luma_h).transpose(0, 2, 1, 3).reshape(-1, f.mcu_w * f.luma_h)
            h = -(-f.height // 8) if f.luma_v == 1 else grid.shape[0]
            full = np.clip((grid * f.quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            thumbs[i, j] = full[:h]
    return [p if isinstance(p, str) else (p, [thumbs[i, j] for j in range(len(p))]) for i, p in enumerate(parsed)]


def _boxes(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of a grid of boxes that cover the whole thumbnail (repeated where it is smaller than the grid)."""
    for axis, n in ((0, rows), (1, columns)):
        size = thumb.shape[axis]
        if size < n:
            thumb = np.repeat(thumb, -(-n // size), axis=axis)
            size = thumb.shape[axis]
        cut = np.arange(n) * size // n
        widths = np.diff(np.append(cut, size)).reshape((-1, 1) if axis == 0 else (1, -1))
        thumb = np.add.reduceat(thumb.astype(np.float64), cut, axis=axis) / widths
    return thumb


def gradient_hash(thumbs: list[np.ndarray]) -> str:
    """64-bit horizontal gradient hash of the box means, weighted over all frames by their height."""
    small = sum(_boxes(t, 8, 9) * len(t) for t in thumbs)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def _pad(text: bytes) -> bytes:
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add binary column ``media``: each text stored losslessly as baseline JPEG.

    ``media`` stands where ``text`` did; all other columns stay.
    """
    order = [f"`{media if c == text else c}`" for c in df.columns if c == text or c.lower() != media.lower()]
    names = [f"`{c}`" for c in df.columns if c != text and c.lower() != media.lower()]
    df = df.select(*names, F.col(f"`{text}`").alias(media))
    schema, build = adder(df, [T.StructField(media, T.BinaryType())])

    def run(batches):
        for batch in batches:
            made: list[bytes] = []
            for _, part in text_slices(batch.column(len(names)), BATCH_BYTES):
                made += encode_payloads([_pad(x) for x in part], [len(x).to_bytes(8, "big") for x in part])
            yield build(batch, [pa.array(made, pa.binary())])

    return df.mapInArrow(run, schema).select(*order)


MEDIA_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, frames int, feature string, error string"


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Read a media column back: dimensions, thumbnail hash, digest of the thumbnail samples.

    The media column is replaced by ``MEDIA_FIELDS``; ``height`` adds up over frames.
    """
    found = T.StructType.fromDDL(MEDIA_FIELDS)
    own = {f.name.lower() for f in found}
    df = df.select(*(f"`{c}`" for c in df.columns if c != media and c.lower() not in own), f"`{media}`")
    kept = df.schema.fields[:-1]

    def one(data: bytes | None, what) -> tuple:
        size, digest = len(data or b""), hashlib.sha256(data or b"").hexdigest()
        if isinstance(what, str):
            return (None, None, None, None, size, digest, None, None, None, None, what)
        frames, thumbs = what
        payload = b"".join(t.tobytes() for t in thumbs)
        note = frames[0].note
        n = int.from_bytes(note, "big") if len(note) == 8 else None
        height, width = sum(f.height for f in frames), frames[0].width
        label = f"jpeg {width}x{height} in {len(frames)} thumb {gradient_hash(thumbs)}"
        return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, digest, width, height, len(frames), label, None)

    def run(batches):
        for batch in batches:
            stored = batch.column(len(kept))
            rows: list[tuple] = []
            for a, b in slices((pc.fill_null(pc.binary_length(stored), 0).to_numpy(zero_copy_only=False) + 1).tolist(), BATCH_BYTES):
                items = stored.slice(a, b - a).to_pylist()
                rows += [one(d, w) for d, w in zip(items, thumbnails(items), strict=True)]
            columns = batch.columns[:-1]
            kinds = {"long": pa.int64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
            columns += [pa.array([r[i] for r in rows], kinds[f.dataType.simpleString()]) for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + found.names)

    return df.mapInArrow(run, T.StructType(kept + list(found)))


def media_features(docs: DataFrame) -> DataFrame:
    """``documents`` -> doc_id and what is read back from its stored media."""
    stored = encode_media(docs.select("doc_id", "text"))
    return read_media(stored).select("doc_id", *T.StructType.fromDDL(MEDIA_FIELDS).names[:-1], F.col("error").alias("media_error"))
