"""ISO media containers as columns.

``describe`` walks the nested boxes of a container and decodes the sample tables of each track, those of fragments too:
codec, duration, and the byte ranges and times of keyframes, from box headers and tables alone; payloads are never
decoded. ``wrap`` stores a payload losslessly as a track of 576-byte units of unsigned 8-bit samples, ``unwrap`` reads
the stored units back through the tables.

Defined results: null and empty texts give one unit of padding; bytes that aren't a container, are cut short or have
tables that contradict each other give an error message and no tracks, never an exception, and no table takes more
memory than a small multiple of the container's size; tracks without a sync table have only keyframes; without time
tables times are null; very long texts are stored whole; null doc_ids and repeated rows keep rows of their own; an
empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.chunks import bounded_batches, texts_of

UNIT, RATE, PER_CHUNK, PAD = 576, 8000, 8, b"\xff"
#: Boxes that hold boxes.
CONTAINERS = {b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
#: Flags of fragment headers and runs, and of a sample that isn't a keyframe.
BASE, ENTRY, DURATION, SIZE, FLAGS, EMPTY, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x10000, 0x20000
OFFSET, FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEY = 0x10000
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TRACKS = "array<struct<codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<first:long,size:long,time:long>>>>"


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Presentation times of the keyframes in units of the timescale, None where they aren't stored.
    times: np.ndarray | None = None
    number: int = 0
    #: Decoding time after the last sample.
    end: int = 0

    def keyframes(self) -> list[tuple[int, int]]:
        """First byte and size of every keyframe."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    """A box with version and flags 0."""
    return box(kind, b"\0\0\0\0", *parts)


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of a unit."""
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def wrap(payload: bytes) -> bytes:
    """A container with the payload, whose length is a multiple of a unit, as its one track."""
    units = len(payload) // UNIT
    chunks = -(-units // PER_CHUNK)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    duration = units * UNIT
    wide = len(payload) > (1 << 31)

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * UNIT)
        runs = [(1, PER_CHUNK, 1)] if chunks * PER_CHUNK == units else [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, units - (chunks - 1) * PER_CHUNK, 1)]
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * PER_CHUNK + 1).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1")))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        long_ = duration >= 1 << 32
        mdhd = (
            box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0))
            if long_
            else full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration, 0x55C4, 0))
        )
        short = min(duration, (1 << 32) - 1)
        tkhd = box(b"tkhd", b"\0\0\0\3", struct.pack(">IIIII", 0, 0, 1, 0, short), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, short, 1 << 16, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    before = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(before), head, payload))


def walk(data: memoryview, begin: int, end: int):
    """Kind, first and last byte (exclusive) of the bodies of the boxes from begin to end."""
    while begin < end:
        if end - begin < 8:
            raise ValueError(f"a box at {begin} is cut short")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise ValueError(f"a box at {begin} is cut short")
            size, body = struct.unpack_from(">Q", data, begin + 8)[0], begin + 16
        elif size == 0:
            size = end - begin
        if size < body - begin or begin + size > end:
            raise ValueError(f"a box at {begin} has a wrong size")
        yield kind, body, begin + size
        begin += size


def _table(data: memoryview, body: int, end: int, kind: str, width: int, skip: int = 4) -> np.ndarray:
    count = struct.unpack_from(">I", data, body + skip)[0]
    first = body + skip + 4
    if first + count * width * int(kind[-1]) > end:
        raise ValueError(f"a table at {body} is cut short")
    return np.frombuffer(data, kind, count * width, first).astype(np.int64).reshape(count, width)


def _sizes(data: memoryview, boxes: dict) -> np.ndarray:
    if b"stz2" in boxes:
        body, last = boxes[b"stz2"]
        bits, count = data[body + 7], struct.unpack_from(">I", data, body + 8)[0]
        if bits not in (4, 8, 16) or body + 12 + (count * bits + 7) // 8 > last:
            raise ValueError(f"a table at {body} is cut short")
        raw = np.frombuffer(data, ">u2" if bits == 16 else ">u1", (count * bits + 7) // 8 // (2 if bits == 16 else 1), body + 12)
        if bits == 4:
            raw = np.stack((raw >> 4, raw & 15), axis=1).ravel()[:count]
        return raw.astype(np.int64)
    body, last = boxes[b"stsz"]
    size, count = struct.unpack_from(">II", data, body + 4)
    if size == 0:
        return _table(data, body, last, ">u4", 1, 8)[:, 0]
    if size * count > len(data):
        raise ValueError("samples exceed the data")
    return np.full(count, size, np.int64)


def _at_runs(runs: np.ndarray, samples: np.ndarray, summed: bool) -> np.ndarray:
    """The values of samples by a table of (count, value) runs, or the sums of the values before them."""
    ends = np.cumsum(runs[:, 0])
    at = np.searchsorted(ends, samples, side="right")
    if len(samples) and (not len(ends) or at.max() >= len(ends)):
        raise ValueError("a time table ends before the samples")
    if not summed:
        return runs[at, 1]
    before = np.concatenate(([0], np.cumsum(runs[:, 0] * runs[:, 1])))
    return before[at] + (samples - np.concatenate(([0], ends))[at]) * runs[at, 1]


def _track(data: memoryview, begin: int, end: int) -> Track:
    out, boxes, open_ = Track(), {}, [(begin, end)]
    while open_:
        for kind, body, last in walk(data, *open_.pop()):
            if kind in CONTAINERS:
                open_.append((body, last))
            else:
                boxes.setdefault(kind, (body, last))
    if b"tkhd" in boxes:
        body, _ = boxes[b"tkhd"]
        out.number = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))[0]
    if b"mdhd" in boxes:
        body, _ = boxes[b"mdhd"]
        out.timescale, out.duration = struct.unpack_from(">IQ", data, body + 20) if data[body] == 1 else struct.unpack_from(">II", data, body + 12)
        out.duration &= (1 << 63) - 1
    if b"stsd" in boxes:
        body, last = boxes[b"stsd"]
        out.codec = next((k.decode("latin-1") for k, _, _ in walk(data, body + 8, last)), "")
    if b"stsc" not in boxes or not {b"stsz", b"stz2"} & boxes.keys() or not {b"stco", b"co64"} & boxes.keys():
        return out
    out.sizes = _sizes(data, boxes)
    n = len(out.sizes)
    wide = b"co64" in boxes
    chunk_at = _table(data, *boxes[b"co64" if wide else b"stco"], ">u8" if wide else ">u4", 1)[:, 0]
    runs = _table(data, *boxes[b"stsc"], ">u4", 3)
    if len(runs) and len(chunk_at):
        spans = np.diff(np.append(runs[:, 0], len(chunk_at) + 1))
        if (spans < 0).any() or runs[0, 0] != 1:
            raise ValueError("chunk runs are out of order")
        full_at = np.cumsum(np.minimum(np.repeat(runs[:, 1], spans), n))
        if full_at[-1] < n:
            raise ValueError("samples without a chunk")
        chunk = np.searchsorted(full_at, np.arange(n), side="right")
        begins = np.cumsum(out.sizes) - out.sizes
        first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))[:n]
        out.offsets = chunk_at[chunk] + begins - np.repeat(begins[first], np.diff(np.append(first, n)))
    elif n:
        raise ValueError("samples without a chunk")
    if b"stss" in boxes:
        keys = _table(data, *boxes[b"stss"], ">u4", 1)[:, 0] - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("a sync sample doesn't exist")
        out.keys = keys
    else:
        out.keys = np.arange(n)
    if n and ((out.offsets + out.sizes).max() > len(data) or out.offsets.min() < 0):
        raise ValueError("samples exceed the data")
    if b"stts" in boxes:
        spans = _table(data, *boxes[b"stts"], ">u4", 2)
        out.times, out.end = _at_runs(spans, out.keys, True), int((spans[:, 0] * spans[:, 1]).sum())
        if b"ctts" in boxes:
            shifts = _table(data, *boxes[b"ctts"], ">u4", 2)
            if data[boxes[b"ctts"][0]] == 1:
                shifts[:, 1] = (shifts[:, 1] ^ (1 << 31)) - (1 << 31)
            out.times = out.times + _at_runs(shifts, out.keys, False)
    return out


def _fields(data: memoryview, at: int, flags: int, kinds) -> tuple[dict[int, int], int]:
    """The optional fields of a header that flags tell of, and the byte after them."""
    found = {}
    for flag, kind in kinds:
        if flags & flag:
            found[flag] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return found, at


def _fragment(data: memoryview, moof: int, begin: int, end: int, found: dict[int, Track], extends: dict[int, tuple]) -> None:
    """Add the samples of a track fragment (begin to end, in a fragment that starts at moof) to its track."""
    inner = list(walk(data, begin, end))
    body = next((b for k, b, _ in inner if k == b"tfhd"), None)
    if body is None:
        raise ValueError("a fragment without a header")
    flags, number = struct.unpack_from(">I", data, body)[0] & 0xFFFFFF, struct.unpack_from(">I", data, body + 4)[0]
    if number not in found:
        raise ValueError("a fragment of an unknown track")
    track, (length, size, kind) = found[number], extends.get(number, (0, 0, 0))
    head, _ = _fields(data, body + 8, flags, ((BASE, ">Q"), (ENTRY, ">I"), (DURATION, ">I"), (SIZE, ">I"), (FLAGS, ">I")))
    length, size, kind = head.get(DURATION, length), head.get(SIZE, size), head.get(FLAGS, kind)
    base = at = head.get(BASE, moof)
    for k, b, _ in inner:
        if k == b"tfdt":
            track.end = struct.unpack_from(">Q" if data[b] == 1 else ">I", data, b + 4)[0] & ((1 << 62) - 1)
    for k, b, last in inner:
        if k != b"trun":
            continue
        version, flags, count = data[b], struct.unpack_from(">I", data, b)[0] & 0xFFFFFF, struct.unpack_from(">I", data, b + 4)[0]
        own, first = _fields(data, b + 8, flags, ((OFFSET, ">i"), (FIRST_FLAGS, ">I")))
        names = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
        if first + 4 * len(names) * count > last or not names and count > len(data):
            raise ValueError(f"a table at {b} is cut short")
        columns = np.frombuffer(data, ">u4", count * len(names), first).astype(np.int64).reshape(count, len(names)).T
        values = dict(zip(names, columns, strict=True))
        sizes = values.get(RUN_SIZE, np.full(count, size, np.int64))
        lengths = values.get(RUN_DURATION, np.full(count, length, np.int64))
        kinds = values.get(RUN_FLAGS, np.full(count, kind, np.int64))
        if FIRST_FLAGS in own and count:
            kinds = np.concatenate(([own[FIRST_FLAGS]], kinds[1:]))
        shifts = values.get(RUN_SHIFT, np.zeros(count, np.int64))
        if version == 1:
            shifts = (shifts ^ (1 << 31)) - (1 << 31)
        at = base + own[OFFSET] if OFFSET in own else at
        offsets = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
        if count and (offsets.min() < 0 or at > len(data)):
            raise ValueError("samples exceed the data")
        keys = np.flatnonzero(kinds & NO_KEY == 0)
        times = track.end + np.cumsum(lengths) - lengths + shifts
        if track.times is not None or not len(track.keys):
            track.times = np.concatenate((np.zeros(0, np.int64) if track.times is None else track.times, times[keys]))
        track.keys = np.concatenate((track.keys, keys + len(track.sizes)))
        track.sizes, track.offsets = np.concatenate((track.sizes, sizes)), np.concatenate((track.offsets, offsets))
        track.end += int(lengths.sum())


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container; ValueError if it isn't one, is cut short or contradicts itself."""
    view, out, known, extends, moofs = memoryview(data), [], False, {}, []
    try:
        for kind, body, end in walk(view, 0, len(view)):
            known |= kind in (b"ftyp", b"moov")
            if kind == b"moov":
                for k, b, e in walk(view, body, end):
                    if k == b"trak":
                        out.append(_track(view, b, e))
                    elif k == b"mvex":
                        for k2, b2, _ in walk(view, b, e):
                            if k2 == b"trex":
                                number, _, length, size, flags = struct.unpack_from(">5I", view, b2 + 4)
                                extends[number] = (length, size, flags)
            elif kind == b"moof":
                moofs.append((body, end))
        found = {t.number: t for t in out}
        for body, end in moofs:
            for k, b, e in walk(view, body, end):
                if k == b"traf":
                    _fragment(view, body - 8, b, e, found, extends)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError("a box is cut short") from e
    if not known:
        raise ValueError("not an ISO media container")
    for t in out:
        if moofs and not t.duration:
            t.duration = t.end
    return out


def unwrap(data: bytes) -> bytes:
    """The bytes of the samples of all tracks, read through the tables."""
    view = memoryview(data)
    return b"".join(view[o : o + s] for t in tracks(data) for o, s in zip(t.offsets.tolist(), t.sizes.tolist(), strict=True))


def feature(track: Track) -> str:
    ranges = ",".join(f"{a}+{n}" for a, n in track.keyframes())
    return f"codec={track.codec.strip()};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={len(track.keys)};ranges={ranges}"


def as_row(track: Track) -> dict:
    times = [None] * len(track.keys) if track.times is None else track.times.tolist()
    keyframes = [{"first": a, "size": n, "time": t} for (a, n), t in zip(track.keyframes(), times, strict=True)]
    return {"codec": track.codec, "timescale": track.timescale, "duration": track.duration, "samples": len(track.sizes), "keyframes": keyframes}


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the container (media) of every text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            media = [wrap(padded(t.encode("utf-8", "surrogatepass"))) for t in texts_of(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """doc_id, tracks (codec, timescale, duration, samples, keyframe ranges) and error of a column media."""

    def run(batches):
        for batch in batches:
            found, errors = [], []
            for data in batch.column("media").to_pylist():
                try:
                    found.append([as_row(t) for t in tracks(data or b"")])
                    errors.append(None)
                except ValueError as e:
                    found.append([])
                    errors.append(str(e))
            key = pa.struct([("first", pa.int64()), ("size", pa.int64()), ("time", pa.int64())])
            kind = pa.list_(pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(key))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, kind), pa.array(errors, pa.string())], ["doc_id", "tracks", "error"])

    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id long, tracks {TRACKS}, error string")


def _features(batches):
    for batch in batches:
        columns = [[] for _ in range(7)]
        for text in texts_of(batch.column("text")).to_pylist():
            data = text.encode("utf-8", "surrogatepass")
            media = wrap(padded(data))
            (track,) = tracks(media)
            back = unwrap(media)
            values = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(track))
            for c, v in zip(columns, values, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])


def text_features(docs: DataFrame) -> DataFrame:
    """Store every text as a container, read it back and describe it; one narrow pass."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_features, FEATURES)
