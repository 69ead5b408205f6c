import hashlib
import random
import resource
import struct
import zlib

import pytest

from tideline.llm import media
from tideline.llm.media import box, full


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 8 + 1, 576 * 16, 100_000])
def test_round_trip(n):
    payload = media.padded(random.Random(n).randbytes(n))
    assert len(payload) % 576 == 0 and len(payload) >= max(576, n)
    stored = media.wrap(payload)
    assert media.unwrap(stored) == payload
    (t,) = media.tracks(stored)
    units = len(payload) // 576
    assert (t.codec, t.timescale, t.duration, len(t.sizes)) == ("raw ", 8000, len(payload), units)
    first = stored.index(b"mdat") + 4
    assert t.keyframes() == [(first + 576 * i, 576) for i in range(0, units, 8)]


def hand_made():
    """Two chunks with samples of sizes 3, 5 | 2 out of order in the file, 64-bit offsets, no sync table."""
    ftyp = box(b"ftyp", b"isom", bytes(4))
    mdat = box(b"mdat", b"CC--AAABBBBB")
    at = len(ftyp) + 8
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(20))),
        full(b"stsz", struct.pack(">II", 0, 3), struct.pack(">3I", 3, 5, 2)),
        full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 2, 1, 1)),
        full(b"co64", struct.pack(">I", 2), struct.pack(">2Q", at + 4, at)),
    )
    mdhd = box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, 90000, 1 << 33), bytes(4))
    trak = box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))
    moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(trak)) + trak
    return ftyp + mdat + moov, at


def test_variable_sizes_and_long_boxes():
    data, at = hand_made()
    (t,) = media.tracks(data)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 90000, 1 << 33)
    assert t.keyframes() == [(at + 4, 3), (at + 7, 5), (at, 2)]
    assert media.unwrap(data) == b"AAABBBBBCC"


def test_damage_never_crashes():
    data, _ = hand_made()
    rng = random.Random(3)
    for _ in range(3000):
        bad = bytearray(data[: rng.randint(0, len(data))] if rng.random() < 0.5 else data)
        for _ in range(rng.randint(0, 4)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            media.unwrap(bytes(bad))
        except ValueError:
            pass


def test_nested_boxes_and_wild_tables_are_errors(spark):
    deep = b""
    for _ in range(3000):
        deep = box(b"trak", deep)
    nested = box(b"ftyp", b"isom") + box(b"moov", deep)
    stbl = box(
        b"stbl",
        full(b"stsz", struct.pack(">II", 1, 20_000)),
        full(b"stsc", struct.pack(">I", 1), struct.pack(">3I", 1, 2**32 - 1, 1)),
        full(b"stco", struct.pack(">I", 15_000), bytes(60_000)),
    )
    wild = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl)))) + box(b"mdat", bytes(20_000))
    began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [len(t.sizes) for t in media.tracks(wild)] == [20_000] and len(media.tracks(nested)) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - began < 200_000  # kB
    stored = spark.createDataFrame([(1, nested), (2, wild), (3, nested[:-5]), (4, b"")], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.describe(stored).collect()}
    assert got[1].error is None and got[2].error is None and got[3].error and got[4].error
    assert media.describe(stored.where("false")).count() == 0


def test_compact_sizes_and_time_tables():
    ftyp, mdat = box(b"ftyp", b"isom", bytes(4)), box(b"mdat", b"AAABBBBBCC")
    for bits, packed in ((4, bytes([0x35, 0x20])), (8, bytes([3, 5, 2])), (16, struct.pack(">3H", 3, 5, 2))):
        stbl = box(
            b"stbl",
            full(b"stz2", struct.pack(">II", bits, 3), packed),
            full(b"stsc", struct.pack(">I", 1), struct.pack(">3I", 1, 3, 1)),
            full(b"stco", struct.pack(">II", 1, len(ftyp) + 8)),
            full(b"stss", struct.pack(">3I", 2, 1, 3)),
            full(b"stts", struct.pack(">5I", 2, 1, 100, 2, 40)),
            box(b"ctts", b"\1\0\0\0", struct.pack(">IIiIi", 2, 2, 7, 1, -5)),
        )
        data = ftyp + mdat + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))))
        (t,) = media.tracks(data)
        assert media.unwrap(data) == b"AAABBBBBCC"
        assert [k["time"] for k in media.as_row(t)["keyframes"]] == [7, 135] and t.keyframes() == [(len(ftyp) + 8, 3), (len(ftyp) + 16, 2)]


def test_fragments():
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 5, 0, 0), bytes(60))
    moov = box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd)), box(b"mvex", full(b"trex", struct.pack(">5I", 5, 1, 20, 4, 0x10000))))
    head = box(b"ftyp", b"iso5", bytes(4)) + moov

    def moof(shift):
        run = box(b"trun", struct.pack(">I", 0x000205), struct.pack(">IiI3I", 3, shift, 0, 2, 3, 1))
        return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", box(b"tfhd", struct.pack(">II", 0x020000, 5)), run))

    part = moof(len(moof(0)) + 8) + box(b"mdat", b"aabbbc")
    data = head + part + part
    (t,) = media.tracks(data)
    assert media.unwrap(data) == b"aabbbcaabbbc" and t.duration == 120
    first = len(head) + len(moof(0)) + 8
    assert t.keyframes() == [(first, 2), (first + len(part), 2)]
    assert [k["time"] for k in media.as_row(t)["keyframes"]] == [0, 60]
    rng = random.Random(8)
    for _ in range(3000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            media.unwrap(bytes(bad[: rng.randint(0, len(bad))] if rng.random() < 0.3 else bad))
        except ValueError:
            pass


def test_query_columns(spark):
    rows = [(1, "Grüße"), (2, None), (3, ""), (None, "x" * 576), (1, "Grüße"), (4, "long text " * 30_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, feature string")
    got = sorted(map(tuple, media.text_features(docs).collect()), key=str)
    want = []
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        stored = media.wrap(payload)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(media.tracks(stored)[0])))
    assert got == sorted(want, key=str)
    assert media.text_features(docs.where("false")).count() == 0


def test_stored_and_described(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    described = media.describe(media.store(docs)).collect()
    assert all(r.error is None and r.tracks[0].codec == "raw " and r.tracks[0].keyframes[0].size == 576 for r in described)
    bad = spark.createDataFrame([(1, b"not media"), (2, None)], "doc_id long, media binary")
    assert all(r.error and not r.tracks for r in media.describe(bad).collect())
