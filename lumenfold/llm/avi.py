"""Media columns in AVI files of motion JPEG.

Storing: a payload is cut into frames of 24 x 24 samples, each a baseline grey JPEG whose 576 quantised
coefficients are the bytes. Byte b is the coefficient whose eight amplitude bits are b (category 8), with a
Huffman table in which that category's code is one 0 bit, quantisation by 1 and a restart after every block, so
every block is 72 bytes before stuffing and all frames are packed in numpy at once. The file has the usual
RIFF lists and an idx1 index.

Reading: the index is parsed and every frame decoded by itself. Frames whose tables give all coefficients the
same width are decoded together in numpy; any other grey baseline frame bit by bit. Inverse transforms use an
integer matrix in doubles, which is exact, so equal files give equal features everywhere.

Shots: each frame's histogram of 16 grey levels is compared with the last; a cut is a difference above the
mean plus two deviations of its neighbourhood and above a tenth of the samples. Clips are the frames between
cuts, timed by the header's frame rate. One map without a shuffle.

Defined cases: a null or empty payload is padded like any other, to one frame. Repeated rows are equal files.
Further columns are carried along; those named as results are replaced. Memory is some 30 bytes a byte of a
million-byte stretch, plus the file. ``read`` raises ValueError for a file that it can't read: no AVI, no index or one
that points beyond the file, colour frames, broken data. ``content`` says so in ``error`` and gives nulls.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_columns

SIDE, BLOCKS, FRAME, FPS = 24, 9, 576, 25
STRETCH = 1 << 11  # frames packed at once
_AMPLITUDE = 8
#: Fixed values of the JPEG format: zigzag order of coefficients, row by row.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_SCALE = 1 << 12
_COSINES = np.round(_SCALE * np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)]))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = bytes([1] + [0] * 15 + [_AMPLITUDE])
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _TABLE)
    + _segment(0xC4, b"\x10" + _TABLE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def _scans(payload: np.ndarray) -> list[bytes]:
    """The coded data of each frame, with its end marker."""
    bits = np.zeros((len(payload), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(payload.reshape(-1, 1), axis=1)
    blocks = np.packbits(bits.ravel()).reshape(-1, 72)
    marked = np.empty((len(blocks), 74), np.uint8)
    marked[:, :72] = blocks
    marked[:, 72] = 0xFF
    marked[:, 73] = np.tile(np.append(np.arange(0xD0, 0xD8), 0xD9), len(blocks) // BLOCKS)
    stuffed = marked == 0xFF
    stuffed[:, 72:] = False
    flat, extra = marked.ravel(), stuffed.ravel()
    ends = np.cumsum(1 + extra)
    out = np.repeat(flat, 1 + extra)
    out[ends[extra] - 1] = 0
    data = out.tobytes()
    stops = [0, *ends[BLOCKS * 74 - 1 :: BLOCKS * 74].tolist()]
    return [data[a:b] for a, b in zip(stops, stops[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write(payload: bytes) -> bytes:
    """An AVI file of the payload's frames; its length must be a positive multiple of 576."""
    values = np.frombuffer(payload, np.uint8)
    parts, index, at, n = [], [], 4, len(values) // FRAME
    for i in range(0, len(values), STRETCH * FRAME):
        for scan in _scans(values[i : i + STRETCH * FRAME]):
            size = len(HEADER) + len(scan)
            parts += [b"00dc", struct.pack("<I", size), HEADER, scan, b"\x00" * (size % 2)]
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
            at += 8 + size + size % 2
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + lists)
    movie = _chunk(b"LIST", b"movi" + b"".join(parts))
    return _chunk(b"RIFF", b"AVI " + head + movie + _chunk(b"idx1", b"".join(index)))


def parse(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the frames by the index) of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movie, index = float(FPS), None, None
    at, stop = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= stop:
        name, size = struct.unpack_from("<4sI", data, at)
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            micros = struct.unpack_from("<I", data, data.index(b"avih", at) + 8)[0]
            fps = 1e6 / micros if micros else fps
        elif name == b"LIST" and kind == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movie is None or index is None or len(index) % 16:
        raise ValueError("no frames or no index")
    entries = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    entries = entries[np.isin(entries["id"], [b"00dc", b"00db"])]
    # Offsets count from the list's name or, in some files, from the file's beginning.
    base = movie if not len(entries) or data[movie + entries["at"][0] :][:4] == entries["id"][0] else 0
    starts = entries["at"].astype(np.int64) + base + 8
    stops = starts + entries["size"]
    if len(entries) and stops.max() > len(data):
        raise ValueError("the index points beyond the file")
    return fps, [data[a:b] for a, b in zip(starts.tolist(), stops.tolist())]


def _tables(frame: bytes) -> dict:
    """What a frame's segments say, and where its coded data begin."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            _, out["height"], out["width"], parts, _, _, out["quant_id"] = struct.unpack_from(">BHHBBBB", body)
            if parts != 1:
                raise ValueError("only grey frames are read")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["huff_ids"] = body[2] >> 4, 16 | (body[2] & 15)
            out["begin"] = at + 2 + size
            return out
        at += 2 + size
    raise ValueError("a frame without coded data")


def _plain(scan: np.ndarray) -> np.ndarray:
    """Coded data without stuffing and markers."""
    mark = np.flatnonzero(scan[:-1] == 0xFF)
    keep = np.ones(len(scan), bool)
    after = scan[mark + 1]
    keep[mark + 1] = False
    keep[mark[after != 0]] = False
    return scan[keep]


def _bit_by_bit(scan: bytes, tables: dict, blocks: int) -> np.ndarray:
    """Coefficients in zigzag order of any grey baseline frame."""
    codes = []
    for k in tables["huff_ids"]:
        counts, values = tables["huff"][k]
        code, made, it = 0, {}, iter(values)
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                made[length, code] = next(it)
                code += 1
            code <<= 1
        codes.append(made)
    out, start = np.zeros((blocks, 64), np.int64), 0
    each = tables["restart"] or blocks
    raw = np.frombuffer(scan, np.uint8)
    marks = [i for i in np.flatnonzero(raw[:-1] == 0xFF) if raw[i + 1] != 0]
    for k in range(0, blocks, each):
        stop = marks[k // each] if k // each < len(marks) else len(raw)
        bits = "".join(map("{:08b}".format, _plain(np.append(raw[start:stop], 0))[:-1].tolist()))
        start, at, last = stop + 2, 0, 0

        def symbol(made: dict) -> int:
            nonlocal at
            for length in range(1, 17):
                if (found := made.get((length, int(bits[at : at + length] or "0", 2)))) is not None and at + length <= len(bits):
                    at += length
                    return found
            raise ValueError("broken coded data")

        def amplitude(size: int) -> int:
            nonlocal at
            value = int(bits[at : at + size], 2) if size else 0
            at += size
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for b in range(k, min(k + each, blocks)):
            last = out[b, 0] = last + amplitude(symbol(codes[0]))
            i = 1
            while i < 64:
                pair = symbol(codes[1])
                if pair == 0:
                    break
                i += pair >> 4
                if pair & 15:
                    out[b, i] = amplitude(pair & 15)
                i += 1
    return out


def coefficients(frames: list[bytes]) -> np.ndarray:
    """Quantised coefficients (frame, block, 64) in zigzag order."""
    tables = _tables(frames[0])
    begin, head = tables["begin"], frames[0][: tables["begin"]]
    if (tables["height"] % 8, tables["width"] % 8) != (0, 0):
        raise ValueError("sides must be multiples of 8")
    blocks = tables["height"] * tables["width"] // 64
    steady = tables["restart"] == 1 and all(tables["huff"][k] == (_TABLE[:16], _TABLE[16:]) for k in tables["huff_ids"])
    if steady and all(f.startswith(head) for f in frames):
        scan = _plain(np.frombuffer(b"".join([f[begin:] for f in frames]), np.uint8))
        bits = np.unpackbits(scan).reshape(-1, 9)
        codes = np.packbits(bits[:, 1:], axis=1).ravel().astype(np.int64)
        return np.where(codes >= 128, codes, codes - 255).reshape(len(frames), blocks, 64)
    rows = []
    for f in frames:
        own = _tables(f)
        rows.append(_bit_by_bit(f[own["begin"] :], own, own["height"] * own["width"] // 64))
    return np.stack(rows)


def pixels(coded: np.ndarray, tables: dict) -> np.ndarray:
    """Grey samples (frame, height, width)."""
    n, height, width = len(coded), tables["height"], tables["width"]
    square = np.zeros((n * height * width // 64, 64))
    square[:, ZIGZAG] = (coded * tables["quant"][tables["quant_id"]]).reshape(-1, 64)
    rows = (square.reshape(-1, 8) @ _COSINES).reshape(-1, 8, 8).transpose(0, 2, 1)
    both = (np.ascontiguousarray(rows).reshape(-1, 8) @ _COSINES).reshape(-1, 8, 8).transpose(0, 2, 1)
    grey = np.clip(np.floor(both / (_SCALE * _SCALE) + 0.5) + 128, 0, 255).astype(np.uint8)
    return grey.reshape(n, height // 8, width // 8, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, height, width)


def cuts(histograms: np.ndarray, samples: int, reach: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(frames that begin a new shot, difference of each frame from the last)."""
    change = np.append(0, np.abs(np.diff(histograms, axis=0)).sum(1) // 2)
    n = len(change)
    low, high = np.maximum(np.arange(n) - reach, min(1, n)), np.minimum(np.arange(n) + reach + 1, n)
    sums, squares = (np.concatenate(([0], np.cumsum(x))) for x in (change, change * change))
    count = np.maximum(high - low, 1)
    mean = (sums[high] - sums[low]) / count
    spread = np.sqrt(np.maximum((squares[high] - squares[low]) / count - mean * mean, 0))
    return np.flatnonzero((change > mean + 2 * spread) & (10 * change > samples)), change


def read(data: bytes) -> dict:
    """The payload, the frame count and the clips of an AVI file."""
    fps, frames = parse(data)
    payload, histograms, luma = [], [], []
    samples = 1
    for i in range(0, len(frames), STRETCH):
        part = frames[i : i + STRETCH]
        coded, tables = coefficients(part), _tables(part[0])
        payload.append(np.where(coded > 0, coded, coded + 255).astype(np.uint8).tobytes())
        grey = pixels(coded, tables).reshape(len(part), -1)
        samples = grey.shape[1]
        places = (grey >> 4).astype(np.int64) + 16 * np.arange(len(part))[:, None]
        histograms.append(np.bincount(places.ravel(), minlength=16 * len(part)).reshape(-1, 16))
        luma.append(grey.sum(1, dtype=np.int64))
    histogram = np.concatenate(histograms) if frames else np.zeros((0, 16), np.int64)
    light = np.concatenate(luma) if frames else np.zeros(0, np.int64)
    begins, change = cuts(histogram, samples)
    edges = [0, *begins.tolist(), len(frames)] if frames else []
    clips = [
        {"clip": k, "start_s": a / fps, "end_s": b / fps, "frames": b - a, "luma": int(light[a:b].sum()) // ((b - a) * samples)}
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return {"payload": b"".join(payload), "frames": len(frames), "motion": int(change.max(initial=0)), "clips": clips}


def store(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``media``: an AVI file of each text's padded UTF-8 bytes."""

    def compute(texts: pa.Array) -> list:
        return [pa.array([write(pad((t.as_py() or "").encode("utf-8"))) for t in texts], pa.binary())]

    return add_columns(documents, [text], T.StructType([T.StructField("media", T.BinaryType())]), compute, keep)


CLIP = T.StructType([T.StructField("clip", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("frames", T.IntegerType()), T.StructField("luma", T.IntegerType())])
CONTENT = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("frames", T.IntegerType()), T.StructField("motion", T.IntegerType()), T.StructField("clips", T.ArrayType(CLIP)), T.StructField("error", T.StringType())])
_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("luma", pa.int32())]))


def _read_or_error(data: bytes) -> dict:
    try:
        return read(data)
    except (ValueError, KeyError, IndexError, struct.error) as fault:
        return {"error": str(fault) or type(fault).__name__}


def content(frame: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``frame`` with payload, frames, motion and clips read from the files in ``media``, or the ``error`` that prevents it.

    Null files give nulls, without an error.
    """

    def compute(files: pa.Array) -> list:
        rows = [_read_or_error(f.as_py()) if f.is_valid else {} for f in files]
        kinds = {"payload": pa.binary(), "frames": pa.int32(), "motion": pa.int32(), "clips": _CLIPS, "error": pa.string()}
        return [pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()]

    return add_columns(frame, [media], CONTENT, compute, keep)


def clips(frame: DataFrame, media: str = "media", keys: list[str] | None = None) -> DataFrame:
    """A row for each clip: the ``keys`` of its file, clip number, start and end in seconds, frames, mean grey."""
    keys = keys or ["doc_id"]
    return content(frame, media, [*keys, media]).select(*keys, F.inline("clips"))
