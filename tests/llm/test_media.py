"""Motion-JPEG files: shots, both decoders, other writers' habits and broken files."""

import struct

import numpy as np
import pytest

from lumenfold.llm import avi


def plain_cuts(histograms, samples, reach=8):
    change = [0] + [sum(abs(int(x) - int(y)) for x, y in zip(a, b)) // 2 for a, b in zip(histograms[1:], histograms)]
    found = []
    for i in range(1, len(change)):
        near = change[max(1, i - reach) : i + reach + 1]
        mean = sum(near) / len(near)
        spread = max(sum(x * x for x in near) / len(near) - mean * mean, 0) ** 0.5
        if change[i] > mean + 2 * spread and 10 * change[i] > samples:
            found.append(i)
    return found, change


def test_cuts_are_those_of_plain_python():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 40, 200):
        histograms = rng.multinomial(576, [1 / 16] * 16, n)
        for k in range(20, n, 37):
            histograms[k:] = np.roll(histograms[k:], 5, axis=1) + np.eye(16, dtype=int)[k % 16] * 300
        begins, change = avi.cuts(histograms, 576)
        assert (begins.tolist(), change.tolist()) == plain_cuts(histograms.tolist(), 576)


@pytest.mark.parametrize("seed", range(3))
def test_both_decoders_agree(seed):
    payload = np.random.default_rng(seed).integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    _, frames = avi.parse(avi.write(payload))
    fast = avi.coefficients(frames)
    for frame, wanted in zip(frames, fast):
        tables = avi._tables(frame)
        assert (avi._bit_by_bit(frame[tables["begin"] :], tables, 9) == wanted).all()


def test_other_offsets_and_chunk_names():
    payload = bytes(range(192)) * 9
    data = avi.write(payload)
    movie, at = data.index(b"movi"), data.index(b"idx1") + 8
    absolute = bytearray(data)
    for k in range(at, len(data), 16):
        (offset,) = struct.unpack_from("<I", data, k + 8)
        struct.pack_into("<I", absolute, k + 8, offset + movie)
    assert avi.read(bytes(absolute))["payload"] == payload
    assert avi.read(data.replace(b"00dc", b"00db"))["payload"] == payload


def test_clip_rows_and_broken_files(spark):
    dark, light = bytes([1]) + bytes(575), bytes([255 if i % 64 == 0 else 3 for i in range(576)])
    good = avi.write((dark * 12 + light * 13)[: 576 * 25])
    broken = {2: b"RIFF", 3: good[: len(good) // 2], 4: b"", 5: good[:12] + b"\0" * 40, 6: None}
    rows = spark.createDataFrame([(1, good), *broken.items()], "doc_id long, media binary")
    read = {r.doc_id: r for r in avi.content(rows).collect()}
    assert read[1].error is None and read[1].frames == 25
    assert all(read[k].payload is None and read[k].error for k in (2, 3, 4, 5)) and read[6].error is None and read[6].payload is None
    clips = sorted((r.clip, r.start_s, r.end_s, r.frames) for r in avi.clips(rows).collect())
    assert [c[3] for c in clips] == [12, 13] and clips[0][1] == 0 and clips[0][2] == clips[1][1] == 12 / 25 and clips[1][2] == 1.0
