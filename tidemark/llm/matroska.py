"""Matroska media columns: binary cells muxed to and parsed from EBML, down to packet tables.

``muxed`` stores a payload as 8-bit PCM at 8 kHz: frames of 512 bytes, eight laced frames a block (fixed-size lacing, EBML
lacing where the last frame is shorter), sixteen blocks a cluster, one cue a cluster. ``demuxed`` parses any Matroska cell:
variable-length ids and sizes, unknown-size segments and clusters, simple blocks and block groups, the four kinds of lacing,
tracks and cues. It returns the tracks, each track's packets with time, byte range and flags, and the bytes of the first track.
Frame k of a lace has its block's time plus k times the track's default duration; else k shares of the block's duration, if
it has one; else the block's time.

Nulls and odd input: a null payload is an empty one; a null or empty cell, or one without a header, has no packets and the
error ``not Matroska``; a cell cut short yields its whole packets and the error ``truncated``. Repeated rows stay rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm._common import small_batches, with_arrow

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Levels of elements that end those of unknown size, and elements whose children are read.
LEVELS = {EBML: 0, SEGMENT: 0, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1, SEEK_HEAD: 1, CHAPTERS: 1, TAGS: 1, ATTACHMENTS: 1}
ENTERED = frozenset((SEGMENT, INFO, TRACKS, CLUSTER, CUES))

FRAME, BLOCK_FRAMES, CLUSTER_BLOCKS, RATE = 512, 8, 16, 8000
PACKET = {"track": pa.int32(), "cluster": pa.int32(), "block": pa.int32(), "frame": pa.int32(), "timestamp_ns": pa.int64(), "keyframe": pa.bool_(), "lacing": pa.string(), "byte_offset": pa.int64(), "byte_length": pa.int64()}
CUE = {"time_ns": pa.int64(), "track": pa.int32(), "cluster_offset": pa.int64()}
TRACK = {"number": pa.int32(), "uid": pa.decimal128(20, 0), "type": pa.string(), "codec": pa.string(), "default_duration_ns": pa.int64(), "sampling_hz": pa.float64(), "channels": pa.int32(), "bit_depth": pa.int32()}
TRACK_TYPES = {1: "video", 2: "audio", 3: "complex", 16: "logo", 17: "subtitle", 18: "buttons", 32: "control", 33: "metadata"}
LACING = ("none", "xiph", "fixed", "ebml")


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size in as few bytes as can hold it; all ones is kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
TRACK_TABLE = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def _block(payload: bytes, at_ms: int) -> bytes:
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
    head = b"\x81" + struct.pack(">hB", at_ms, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 3:
        head += size_bytes(FRAME) + size_bytes((1 << 6) - 1, 1) * (len(frames) - 2)  # each next size by its difference: nought
    return element(SIMPLE_BLOCK, head + payload)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one PCM track. The payload's length is a multiple of 8, so all times are whole milliseconds."""
    ms = lambda n: n * 1000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"columns") + element(WRITING_APP, b"columns") + element(DURATION, struct.pack(">d", ms(len(payload)))))
    clusters, cues, at, per = [], [], len(info) + len(TRACK_TABLE), FRAME * BLOCK_FRAMES
    for a in range(0, len(payload), per * CLUSTER_BLOCKS):
        part = payload[a : a + per * CLUSTER_BLOCKS]
        clusters.append(element(CLUSTER, number(TIMESTAMP, ms(a)) + b"".join(_block(part[i : i + per], ms(i)) for i in range(0, len(part), per))))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms(a)) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return HEADER + element(SEGMENT, info + TRACK_TABLE + b"".join(clusters) + element(CUES, b"".join(cues)))


class Truncated(ValueError):
    pass


def vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, next place) of a variable-length number; with its marker bit as an id. An unknown size is -1."""
    if at >= len(data) or not data[at]:
        raise Truncated
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Truncated
    n = int.from_bytes(data[at : at + width], "big")
    if not marker:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first, last + 1) of each element's body in data[at:end]; a body of unknown or too great a size ends at the end."""
    while at < end:
        ident, body = vint(data, at, True)
        n, body = vint(data, body, False)
        at = min(end, body + n) if n >= 0 else end
        yield ident, body, at
        if n >= 0 and body + n > end:
            raise Truncated


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise Truncated
    n, at = data[at] + 1, at + 1
    if kind == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Truncated
            size, at = size + data[at], at + 1
        else:
            first = at
            size, at = vint(data, at, False)
            size = (1 << 7 * (at - first)) - 1 if size < 0 else size
            if k:
                size += sizes[-1] - (1 << 7 * (at - first) - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Truncated
    return sizes, at


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float | None:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else None


def track(data: bytes, a: int, b: int) -> tuple:
    """The fields of TRACK of a track entry."""
    of = {i: (c, d) for i, c, d in elements(data, a, b)}
    audio = {i: (c, d) for i, c, d in elements(data, *of[AUDIO])} if AUDIO in of else {}
    whole = lambda x, i: unsigned(data, *x[i]) if i in x else None
    kind = whole(of, TRACK_TYPE)
    codec = data[slice(*of[CODEC_ID])].rstrip(b"\0").decode("ascii", "replace") if CODEC_ID in of else None
    hertz = real(data, *audio[SAMPLING]) if SAMPLING in audio else None
    return whole(of, TRACK_NUMBER), whole(of, TRACK_UID), TRACK_TYPES.get(kind, None if kind is None else str(kind)), codec, whole(of, DEFAULT_DURATION), hertz, whole(audio, CHANNELS), whole(audio, BIT_DEPTH)


def parse(data: bytes) -> tuple[list[tuple], list[tuple], str | None]:
    """(packets, cues, error), packets and cues with the fields of PACKET and CUE."""
    return parse_all(data)[:3]


def parse_all(data: bytes) -> tuple[list[tuple], list[tuple], str | None, list[tuple]]:
    """(packets, cues, error, tracks), the last with the fields of TRACK."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    tracks: list[tuple] = []
    shares: list[int] = []
    if not data or data[:4] != EBML.to_bytes(4, "big"):
        return packets, cues, "not Matroska", tracks
    scale, cluster, n_blocks, now = 1_000_000, -1, 0, 0

    def block(a: int, b: int, simple: bool, key: bool, lasts: int = 0) -> None:
        nonlocal n_blocks
        number, a = vint(data, a, False)
        if a + 3 > b:
            raise Truncated
        shift, flags = struct.unpack_from(">hB", data, a)
        kind = flags >> 1 & 3
        sizes, at = frame_sizes(data, a + 3, b, kind)
        time = (now + shift) * scale
        for k, n in enumerate(sizes):
            shares.append(k * lasts * scale // len(sizes))
            packets.append((number, cluster, n_blocks, k, time, bool(flags & 0x80) if simple else key, LACING[kind], at, n))
            at += n
        n_blocks += 1

    def leaf(ident: int, a: int, b: int, base: int) -> None:
        nonlocal scale, now
        if ident == TRACK_ENTRY:
            tracks.append(track(data, a, b))
        elif ident == TIMESTAMP_SCALE:
            scale = unsigned(data, a, b)
        elif ident == TIMESTAMP:
            now = unsigned(data, a, b)
        elif ident == SIMPLE_BLOCK:
            block(a, b, True, False)
        elif ident == BLOCK_GROUP:
            inner = list(elements(data, a, b))
            lasts = next((unsigned(data, c, d) for i, c, d in inner if i == BLOCK_DURATION), 0)
            for i, c, d in inner:
                if i == BLOCK:
                    block(c, d, False, all(j != REFERENCE for j, _, _ in inner), lasts)
        elif ident == CUE_POINT:
            inner = list(elements(data, a, b))
            time = next((unsigned(data, c, d) for i, c, d in inner if i == CUE_TIME), 0)
            for i, c, d in inner:
                if i == CUE_POSITIONS:
                    of = {j: unsigned(data, e, f) for j, e, f in elements(data, c, d)}
                    cues.append((time * scale, of.get(CUE_TRACK, 0), base + of.get(CUE_CLUSTER, 0)))

    at, base, error = 0, 0, None
    opened: list[tuple[int, int, bool]] = []  # (level, end, whether the end is known) of each element that is entered
    try:
        while at < len(data):
            while opened and at >= opened[-1][1]:
                opened.pop()
            ident, a = vint(data, at, True)
            n, a = vint(data, a, False)
            level = LEVELS.get(ident, 9)
            while opened and not opened[-1][2] and opened[-1][0] >= level:  # an element of unknown size ends at one of its own level
                opened.pop()
            limit = opened[-1][1] if opened else len(data)
            at = a + n if n >= 0 else limit
            if at > limit:
                error, at = "truncated", limit
            if ident in ENTERED:
                opened.append((level, at, n >= 0))
                cluster += ident == CLUSTER
                base = a if ident == SEGMENT else base
                at = a
            elif a + n <= limit:
                leaf(ident, a, at, base)
    except Truncated:
        error = "truncated"
    # Only now, as the tracks may follow their packets.
    step = {t[0]: t[4] for t in tracks if t[4]}
    timed = [(*p[:4], p[4] + (p[3] * step[p[0]] if p[0] in step else share), *p[5:]) if p[3] else p for p, share in zip(packets, shares, strict=True)]
    return timed, cues, error, tracks


#: First whole number that a field of the type can't hold; the least is its opposite.
BEYOND = {pa.int32(): 2**31, pa.int64(): 2**63, pa.decimal128(20, 0): 10**20}


def _lists(rows: list[list[tuple]], fields: dict[str, pa.DataType], wild: set[int]) -> pa.ListArray:
    """A list of structs a cell. A number that its field can't hold is null, and the cell is added to wild."""
    ends, columns = [0], [[] for _ in fields]
    for row in rows:
        ends.append(ends[-1] + len(row))
        for values, x in zip(columns, zip(*row, strict=True), strict=False):
            values.extend(x)
    for values, most in zip(columns, map(BEYOND.get, fields.values()), strict=True):
        if most:
            for i in [i for i, x in enumerate(values) if x is not None and not -most <= x < most]:
                values[i] = None
                wild.add(bisect_right(ends, i) - 1)
    arrays = [pa.array(v, t) for v, t in zip(columns, fields.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, list(fields)))


def tables(cells: list[bytes | None]) -> list[pa.Array]:
    """payload, packets, cues, tracks and error of each cell."""
    found, wild = [parse_all(x or b"") for x in cells], set()
    payload = [b"".join(x[p[7] : p[7] + p[8]] for p in packets if p[0] == packets[0][0]) for x, (packets, *_) in zip(cells, found, strict=True)]
    lists = [_lists([f[i] for f in found], fields, wild) for i, fields in ((0, PACKET), (1, CUE), (3, TRACK))]
    return [pa.array(payload, pa.binary()), *lists, pa.array([f[2] or ("number out of range" if i in wild else None) for i, f in enumerate(found)], pa.string())]


def muxed(df: DataFrame, id_col: str, payload: Column, also: dict[str, Column]) -> DataFrame:
    """(id_col, also's columns, media)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col), *[v.alias(k) for k, v in also.items()], payload.cast("binary").alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [mux(x or b"") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def demuxed(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload (the bytes of the first packet's track), packets, cues, tracks and error; such columns that df has are replaced.

    Any bytes are read: what is cut off, or holds a number beyond its field, which is then null, has an error.
    """
    fields = lambda x: ", ".join(f"{k}: {({pa.int32(): 'int', pa.int64(): 'bigint', pa.bool_(): 'boolean', pa.string(): 'string', pa.float64(): 'double', pa.decimal128(20, 0): 'decimal(20,0)'})[v]}" for k, v in x.items())
    new = StructType.fromDDL(f"payload binary, packets array<struct<{fields(PACKET)}>>, cues array<struct<{fields(CUE)}>>, tracks array<struct<{fields(TRACK)}>>, error string")

    return with_arrow(df, media, lambda: lambda column: tables(column.to_pylist()), new)


def packet_table(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """One row per packet: id_col, packet (its place in the cell, from 0) and the fields of PACKET."""
    return demuxed(df.select(id_col, media), media).select(id_col, F.posexplode("packets").alias("packet", "p")).select(id_col, "packet", "p.*")


def padded(text: Column) -> Column:
    """UTF-8 bytes with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    return F.concat(raw, F.expr("cast(repeat(decode(X'00', 'UTF-8'), 64) as binary)").substr(F.lit(1), F.greatest(F.ceil(n / 64) * 64, F.lit(64)).cast("int") - n))


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest of op7: each whole text through mux and demux. error follows."""
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    read = demuxed(muxed(docs.select("doc_id", "text"), "doc_id", padded(F.col("text")), {"n_bytes": n}))
    last = F.element_at("packets", -1)
    laced = F.size(F.filter("packets", lambda p: p["lacing"] != "none"))
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), F.size("packets")), F.concat(F.lit("blocks="), last["block"] + 1), F.concat(F.lit("clusters="), last["cluster"] + 1),
        F.concat(F.lit("cues="), F.size("cues")), F.concat(F.lit("laced="), laced), F.concat(F.lit("last_ms="), F.floor(last["timestamp_ns"] / 1_000_000)), F.concat(F.lit("last_bytes="), last["byte_length"]),
    )
    size = F.octet_length("payload")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.col("payload").substr(size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "error",
    )
