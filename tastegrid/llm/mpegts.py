"""Media columns: MPEG transport streams.

`mux` stores a byte payload as a transport stream (ISO/IEC 13818-1): program
association and map tables with their CRC, one elementary stream cut into
access units, each a packetised-elementary-stream packet with a presentation
timestamp, program clock references and random-access indicators.  `demux`
reads streams of aligned 188-byte packets back: tables, also over several
packets, continuity counters, with repeated packets and announced
discontinuities, packets, timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tastegrid.llm.common import slices, text_of

# Fixed values of the format.
PACKET, SYNC, PAT_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0, 0x06, 0xBD
CLOCK = 90_000

#: Payload is padded with spaces to a positive multiple of this.
UNIT = 192
#: Bytes of an access unit, ticks between two, and how many there are from one random-access point to the next.
ACCESS_UNIT, TICKS, GROUP = 48 * UNIT, 3600, 8
PMT_PID, MEDIA_PID = 0x100, 0x101


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (5 + len(body) + 4), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\x00" + section
    return head + b"\xff" * (PACKET - len(head))


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000))
)


def _pts(t: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (t >> 29) & 0x0E, ((t >> 14) & 0xFFFE) | 1, ((t << 1) & 0xFFFE) | 1)


def _unit(payload: bytes, k: int, counter: int) -> np.ndarray:
    """The packets of access unit k; counter: continuity counter of the first."""
    t = k * TICKS & (1 << 33) - 1
    pes = np.frombuffer(struct.pack(">IHBBB", 0x100 | STREAM_ID, len(payload) + 8, 0x80, 0x80, 5) + _pts(t) + payload, np.uint8)
    first = PACKET - 12  # after four bytes of header and eight of adaptation field
    n = 1 if len(pes) <= first else 1 + -(-(len(pes) - first) // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    # The clock reference and the random-access flag; a short first packet is stuffed here.
    room = first - min(first, len(pes))
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = 7 + room, 0x10 | (0x40 if k % GROUP == 0 else 0)
    out[0, 6:12] = np.frombuffer(struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00), np.uint8)
    out[0, 12 + room :] = pes[: first - room]
    rest = pes[first - room :]
    if n > 2:
        out[1:-1, 4:] = rest[: (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
    if n > 1:
        end = rest[(n - 2) * (PACKET - 4) :]
        room = PACKET - 4 - len(end)
        if room:
            out[-1, 3] |= 0x20
            out[-1, 4] = room - 1
            if room > 1:
                out[-1, 5] = 0
        out[-1, 4 + room :] = end
    return out


def pad(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit = _unit(payload[at : at + ACCESS_UNIT], k, counter)
        counter = (counter + len(unit)) & 15
        parts.append(unit.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    pts: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    continuity_errors: int = 0
    table_errors: int = 0
    sync_errors: int = 0


def _read_section(whole: bytes) -> tuple[int, bytes] | None:
    """Table id and body of a section, if it is whole."""
    if len(whole) < 12 or crc32_mpeg(whole):
        return None
    return whole[0], whole[8:-4]


def _sections(packets: list[tuple[bool, bool, bytes]]) -> Iterator[bytes | None]:
    """The sections in a PID's payloads (whether one begins here, whether packets before are missing, bytes); None for one that is cut off.

    A section may span packets, and a packet may hold several, up to stuffing.
    """
    held: bytes | None = None

    def whole(data: bytes) -> tuple[list[bytes], bytes | None]:
        out = []
        while data and data[0] != 0xFF:
            size = 3 + (struct.unpack_from(">H", data, 1)[0] & 0xFFF) if len(data) >= 3 else 3
            if len(data) < size or size == 3:
                return out, data
            out.append(data[:size])
            data = data[size:]
        return out, None

    for begins, gap, data in packets:
        if gap and held is not None:
            yield None
            held = None
        if not begins:
            found, held = whole(held + data) if held is not None else ([], None)
            yield from found
            continue
        first = 1 + data[0] if data else 0
        if held is not None:
            found, rest = whole(held + data[1:first])
            yield from found
            if rest is not None:
                yield None
        if not data[first:] or data[first] == 0xFF:
            yield None  # none begins where one should
        found, held = whole(data[first:])
        yield from found
    if held is not None:
        yield None


def _repeats(q: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of a PID's packets with payload repeat the one before; the format allows one repeat of each."""
    if len(q) < 2:
        return np.zeros(len(q), bool)
    # The clock reference in the adaptation field may differ.
    alike = (q[1:] == q[:-1]) | ((np.arange(PACKET)[None, :] >= 5) & (np.arange(PACKET)[None, :] < start[1:, None]))
    same = np.concatenate([[False], alike.all(axis=1)])
    for i in np.flatnonzero(same):
        same[i] = not same[i - 1]
    return same


def demux(data: bytes) -> Stream:
    """Read a transport stream; damaged packets are counted, the rest is kept."""
    out = Stream()
    whole = len(data) // PACKET * PACKET
    p = np.frombuffer(data[:whole], np.uint8).reshape(-1, PACKET)
    good = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)
    out.sync_errors = int((~good).sum()) + (len(data) != whole)
    p = p[good]
    out.packets = len(p)
    if not len(p):
        return out
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    adapted, filled = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    start = np.where(adapted, 5 + p[:, 4].astype(np.int32), 4)
    begins = p[:, 1] & 0x40 != 0

    jumps = adapted & (p[:, 4] > 0) & (p[:, 5] & 0x80 != 0)

    def packets_of(of: int) -> tuple[np.ndarray, np.ndarray]:
        """A PID's packets with payload but for repeats, and before which of them some are missing."""
        own = np.flatnonzero((pid == of) & filled)
        own = own[~_repeats(p[own], start[own])]
        cc = p[own, 3] & 15
        gap = np.zeros(len(own), bool)
        gap[1:] = ((cc[1:] - cc[:-1]) & 15 != 1) & ~jumps[own[1:]]
        return own, gap

    def sections(of: int, table: int) -> Iterator[bytes]:
        own, gap = packets_of(of)
        for section in _sections([(bool(begins[i]), bool(g), p[i, start[i] :].tobytes()) for i, g in zip(own, gap)]):
            found = _read_section(section) if section is not None else None
            if found is None or found[0] != table:
                out.table_errors += 1
            else:
                yield found[1]

    for body in sections(PAT_PID, 0):
        out.programs |= {a: b & 0x1FFF for a, b in struct.iter_unpack(">HH", body) if a}
    for table_pid in out.programs.values():
        for body in sections(table_pid, 2):
            at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
            while at + 5 <= len(body):
                kind, media, more = struct.unpack_from(">BHH", body, at)
                out.streams[media & 0x1FFF] = kind
                at += 5 + (more & 0xFFF)
    parts: list[bytes] = []
    size = 0
    for media in out.streams:
        own, gap = packets_of(media)
        if not len(own):
            continue
        q, s, b = p[own], start[own], begins[own]
        out.continuity_errors += int(gap.sum())
        bytes_ = q[np.arange(PACKET)[None, :] >= s[:, None]].tobytes()
        ends = np.cumsum(PACKET - np.minimum(s, PACKET))
        first = np.flatnonzero(b)
        bounds = [*(ends[first] - (PACKET - np.minimum(s[first], PACKET))), len(bytes_)]
        entry = (q[:, 3] & 0x20 != 0) & (q[:, 4] > 0) & (q[:, 5] & 0x40 != 0)
        for i, a, z in zip(first, bounds, bounds[1:]):
            head = bytes_[a : a + 14]
            if len(head) < 9 or head[:3] != b"\x00\x00\x01":
                out.table_errors += 1
                continue
            if head[7] & 0x80 and len(head) == 14:
                h, m, low = struct.unpack(">BHH", head[9:14])
                out.pts.append((h >> 1 & 7) << 30 | (m >> 1) << 15 | low >> 1)
            else:
                out.pts.append(-1)
            out.offsets.append(size)
            if entry[i]:
                out.random_access.append(len(out.pts) - 1)
            said = struct.unpack(">H", head[4:6])[0]
            body = bytes_[a + 9 + head[8] : z if not said else min(z, a + 6 + said)]
            parts.append(body)
            size += len(body)
    out.payload = b"".join(parts)
    return out


def describe(s: Stream) -> str:
    """Timestamps with their random-access points, as a short text."""
    points = ",".join(f"{s.pts[i]}@{s.offsets[i]}" for i in s.random_access)
    last = s.pts[-1] if s.pts else -1
    return f"packets={s.packets};units={len(s.pts)};last_pts={last};cc_errors={s.continuity_errors};rap={points}"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store every whole text as a transport stream, read it back and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, n_units, n_random_access and, with
    keep_media=True, media (the stream).

    A null text counts as empty and is stored as one unit of padding.  A null
    doc_id stays null; repeated rows give repeated results; an empty table gives
    none; other columns are not read.
    """
    kind = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string, n_units bigint, n_random_access bigint"
    ) + ", media binary" * keep_media
    names = [x.split()[0] for x in kind.split(", ")]

    def one(text: str) -> tuple:
        raw = text.encode("utf-8")
        media = mux(pad(raw))
        back = demux(media)
        row = (len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-16:]), len(media))
        row += (hashlib.sha256(media).hexdigest(), describe(back), len(back.pts), len(back.random_access))
        return row + (media,) * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for part in slices(batch):
                rows = [one(t) for t in part.column(1).to_pylist()]
                cols = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(run, kind)


def media_index(media: DataFrame) -> DataFrame:
    """One row for each access unit of a media column: doc_id, unit, pts, seconds, offset, random_access, and the stream's continuity errors."""
    kind = "doc_id bigint, unit int, pts bigint, seconds double, offset bigint, random_access boolean, continuity_errors int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = demux(data or b"")
                entry = set(s.random_access)
                rows += [(key, i, t, t / CLOCK, o, i in entry, s.continuity_errors) for i, (t, o) in enumerate(zip(s.pts, s.offsets))]
            names = [x.split()[0] for x in kind.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return media.select(media["doc_id"].cast("bigint").alias("doc_id"), media["media"]).mapInArrow(run, kind)
