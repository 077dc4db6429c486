"""Media columns: payloads stored in ISO media containers, and a reader that walks the boxes.

``to_media`` stores bytes losslessly as a track of fixed-size access units: file type, movie header, one track with its
sample tables, and the media data. ``probe_media`` walks the nested boxes of such a file or of any other, decodes the
sample tables of its first video track, or else of its first whole track, and returns codec, duration and the byte
ranges of the keyframes. Payloads are only sliced, never decoded. What a file says of itself is held against its length
before anything is allocated, and memory follows the length of the file.

Cases: a null payload counts as empty; an empty one is stored as one unit of zeros; bytes that aren't a container, or
whose tables or nesting go beyond them, give null features and no payload; columns of the names that an operator adds are
replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, releasing

UNIT = 64
TIMESCALE = 8000
UNITS_A_CHUNK = 64
UNITS_A_KEYFRAME = 16
MOST_NESTED = 16
_CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf")
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(payload: bytes) -> bytes:
    """Zeros appended up to a positive multiple of UNIT."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def mux(payload: bytes) -> bytes:
    """A container around payload, whose length is a positive multiple of UNIT: 8-bit raw samples in units of UNIT."""
    count = len(payload) // UNIT
    chunks = -(-count // UNITS_A_CHUNK)
    sync = range(1, count + 1, UNITS_A_KEYFRAME)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    rows = [(1, min(count, UNITS_A_CHUNK), 1)]
    if chunks > 1 and count % UNITS_A_CHUNK:
        rows.append((chunks, count % UNITS_A_CHUNK, 1))

    def movie(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        offsets = [first + k * UNITS_A_CHUNK * UNIT for k in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, count, UNIT)),
            _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            _full(b"stsc", struct.pack(">I", len(rows)), *[struct.pack(">3I", *x) for x in rows]),
            _full(b"stsz", struct.pack(">2I", UNIT, count)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        data = _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">4IHH", 0, 0, TIMESCALE, count * UNIT, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", data), stbl),
        )
        track = _full(b"tkhd", struct.pack(">5I8xHHHH", 0, 0, 1, 0, count * UNIT, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3)
        header = _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, count * UNIT, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", header, _box(b"trak", track, media))

    size = len(movie(0))
    wide_data = len(payload) + 8 >= 1 << 32
    start = len(head) + size + (16 if wide_data else 8)
    moov = movie(start)
    if len(moov) != size:  # the offsets needed 64 bits
        moov = movie(start + len(moov) - size)
    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide_data else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((head, moov, lead, payload))


def walk(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path, first byte of the body, its end) of every box, containers before what they hold."""
    stack = [((), 0, len(data))]
    while stack:
        path, start, end = stack.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box ends outside its container")
        yield (*path, kind), body, start + size
        stack.append((path, start + size, end))
        if kind in _CONTAINERS:
            if len(path) >= MOST_NESTED:
                raise ValueError("boxes are nested too deeply")
            stack.append(((*path, kind), body, start + size))


_NEEDED = {b"mdhd", b"stsd", b"stsz", b"stsc"}


def _track(data: bytes) -> dict[bytes, tuple[int, int]]:
    """The boxes of the first video track, or else of the first track that has all that is needed."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, s, e in walk(data):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (s, e))
    whole = [t for t in tracks if t.keys() >= _NEEDED and (b"stco" in t or b"co64" in t)]
    video = [t for t in whole if b"hdlr" in t and data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12] == b"vide"]
    if not whole:
        raise ValueError("no track has all its tables")
    return (video or whole)[0]


def probe(data: bytes) -> dict:
    """codec, timescale, duration, samples as rows of offset and size, and the sync ones among them."""
    boxes = _track(data)

    def numbers(kind: bytes, columns: int = 1, form: str = ">u4", skip: int = 0) -> np.ndarray:
        """A table of a box: its number of rows, and then they."""
        s, e = boxes[kind]
        n, width = struct.unpack_from(">I", data, s + 4 + skip)[0], np.dtype(form).itemsize * columns
        if s + 8 + skip + n * width > e:
            raise ValueError("a table ends outside its box")
        return np.frombuffer(data, form, n * columns, s + 8 + skip).astype(np.int64).reshape(n, columns)

    s, e = boxes[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, s + 20) if data[s] == 1 else struct.unpack_from(">II", data, s + 12)
    if not timescale:
        raise ValueError("no time scale")
    codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1")
    s, _ = boxes[b"stsz"]
    fixed, count = struct.unpack_from(">II", data, s + 4)
    if fixed and fixed * count > len(data):
        raise ValueError("samples are longer than the file")
    sizes = np.full(count, fixed, np.int64) if fixed else numbers(b"stsz", skip=4)[:, 0]
    chunks = numbers(b"co64", form=">i8")[:, 0] if b"co64" in boxes else numbers(b"stco")[:, 0]
    runs = numbers(b"stsc", 3)
    samples = np.zeros((0, 2), np.int64)
    if len(chunks) and len(runs):
        # samples of each chunk: those of the last run that begins at or before it
        run = np.maximum(np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1, 0)
        ends = np.minimum(np.cumsum(np.minimum(runs[run, 1], count)), count)
        per = np.diff(ends, prepend=0)
        sizes = sizes[: ends[-1]]
        before = np.cumsum(sizes) - sizes
        first = np.minimum(ends - per, max(len(sizes) - 1, 0))
        samples = np.column_stack([np.repeat(chunks - (before[first] if len(sizes) else 0), per) + before, sizes])
    if len(samples) and (samples.min() < 0 or samples.sum(axis=1).max() > len(data)):
        raise ValueError("samples lie outside the file")
    sync = numbers(b"stss")[:, 0] if b"stss" in boxes else np.arange(1, len(samples) + 1)
    return {"codec": codec, "timescale": timescale, "duration": duration, "samples": samples, "keyframes": samples[sync[(sync > 0) & (sync <= len(samples))] - 1]}


def demux(data: bytes, samples: np.ndarray) -> bytes:
    """The stored payload. Samples that follow one another are cut out in one slice."""
    if not len(samples):
        return b""
    start, end = samples[:, 0], samples.sum(axis=1)
    cuts = np.append(True, start[1:] != end[:-1])
    # samples may overlap in a damaged file; all of them together are never longer than is allowed
    if int(samples[:, 1].sum()) > len(data):
        raise ValueError("samples are longer than the file")
    return b"".join(data[a:b] for a, b in zip(start[cuts].tolist(), end[np.append(cuts[1:], True)].tolist(), strict=True))


def to_media(rows: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """rows with a binary column of containers in place of the binary column payload, and its length as n_bytes."""
    rest = [c for c in rows.columns if c not in (payload, "n_bytes", out)]
    schema = rows.select(*rest).schema.add("n_bytes", "long").add(out, "binary")
    bound_batches(rows.sparkSession)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [x or b"" for x in b.column(payload).to_pylist()]
            columns = [b.column(c) for c in rest] + [pa.array([len(x) for x in values], pa.int64()), pa.array([mux(padded(x)) for x in values], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n_bytes", out])

    return rows.mapInArrow(run, schema)


def probe_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows without media but with what its containers say: codec, timescale, duration, n_samples, keyframes (arrays of
    offset and size), and the stored payload's and the container's sizes and digests."""
    made = ("codec", "timescale", "duration", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    rest = [c for c in rows.columns if c not in (media, *made)]
    schema = rows.select(*rest).schema
    frames_type = T.ArrayType(T.StructType().add("offset", "long").add("size", "long"))
    for name, kind in (("codec", "string"), ("timescale", "long"), ("duration", "long"), ("n_samples", "long")):
        schema = schema.add(name, kind)
    schema = schema.add("keyframes", frames_type)
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string")):
        schema = schema.add(name, kind)
    frame = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), frame, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def one(data: bytes | None) -> tuple:
        data = data or b""
        tail = (len(data), hashlib.sha256(data).hexdigest())
        try:
            p = probe(data)
            payload = demux(data, p["samples"])
        except (ValueError, KeyError, IndexError, struct.error):
            return (None,) * 8 + tail
        frames = [{"offset": a, "size": b} for a, b in p["keyframes"].tolist()]
        return (p["codec"], p["timescale"], p["duration"], len(p["samples"]), frames, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *tail)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(one, b.column(media).to_pylist()), strict=True)) or [()] * len(kinds)
            columns = [b.column(c) for c in rest] + [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as UTF-8 in a container of its own, and what is read back from it."""
    payload = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    return probe_media(to_media(payload, "payload"))
