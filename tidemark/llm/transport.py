"""MPEG transport streams: a multiplexer and a reader.

The reader parses program association and program map tables (with their CRCs), checks continuity counters, reassembles
elementary packets, and keeps presentation times and random-access points: the places, in bytes, of the transport packets
at which a reader can begin, with the time of what begins there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, slices, stored, table

PACKET, SYNC, PMT_PID, ES_PID, PRIVATE_DATA, STREAM_ID = 188, 0x47, 0x1000, 0x101, 0x06, 0xBD
PES_BYTES, TICKS = 32_768, 3_600  # payload of one elementary packet, and its duration on the 90 kHz clock


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; zero over a section with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _psi(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter, 0) + section).ljust(PACKET, b"\xff")


_PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000))
_TABLES = [_psi(0, _PAT, c) + _psi(PMT_PID, _PMT, c) for c in range(16)]


def _time(mark: int, t: int) -> bytes:
    return bytes((mark << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1))


def mux(payload: bytes, pes_bytes: int = PES_BYTES) -> bytes:
    """A single-program stream: one elementary packet for each pes_bytes, with the tables before every 16th.

    Only the elementary packets behind tables are random-access points: a reader that begins there knows the program.
    """
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), pes_bytes)):
        chunk, pts = payload[at : at + pes_bytes], k * TICKS & (1 << 33) - 1
        if k % 16 == 0:
            out.append(_TABLES[k // 16 % 16])
        body = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(chunk) + 8, 0x84, 0x80, 5) + _time(2, pts) + chunk
        clock = struct.pack(">Q", (pts << 15 | 0x3F << 9) << 16)[:6]
        stuffing = max(0, 176 - len(body))
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | ES_PID, 0x30 | counter, 7 + stuffing, 0x10 if k % 16 else 0x50) + clock + b"\xff" * stuffing + body[:176])
        counter = counter + 1 & 15
        full, rest = divmod(max(0, len(body) - 176), 184)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(full) & 15)
            packets[:, 4:] = np.frombuffer(body, np.uint8, full * 184, 176).reshape(full, 184)
            out.append(packets.tobytes())
            counter = counter + full & 15
        if rest:
            space = 183 - rest
            field = bytes((space,)) + (b"\0" + b"\xff" * (space - 1) if space else b"")
            out.append(struct.pack(">BHB", SYNC, ES_PID, 0x30 | counter) + field + body[-rest:])
            counter = counter + 1 & 15
    return b"".join(out)


def _sections(rows: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Whole sections with a right CRC that begin in packets with a unit start."""
    out = []
    for row, at in zip(rows, starts, strict=True):
        data = row[at:].tobytes()
        i = 1 + data[0] if data else 0
        if i + 3 <= len(data) and data[i] != 0xFF:
            n = 3 + (struct.unpack(">H", data[i + 1 : i + 3])[0] & 0xFFF)
            if i + n <= len(data) and section_crc(data[i : i + n]) == 0:
                out.append(data[i : i + n])
    return out


def demux(stream: bytes) -> dict:
    """programs {number: pmt pid}, streams {pid: type}, packets [(pid, pts or None, random access, payload, place)], counts of errors.

    place is where the elementary packet's first transport packet begins in the stream.  Packets without the sync byte or with the error flag, broken sections, counters that don't follow on, and elementary
    packets shorter than they say are counted, never an exception.  A packet sent twice counts once.
    """
    whole = len(stream) // PACKET
    rows = np.frombuffer(stream, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] < 0x80)
    lost = int((~good).sum()) + bool(len(stream) % PACKET)
    rows, index = rows[good], np.flatnonzero(good)
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    unit, has_field, has_payload = rows[:, 1] & 0x40 > 0, rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    start = np.minimum(np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4), PACKET)
    keep, jumps = has_payload.copy(), 0
    for p in np.unique(pid):
        at = np.flatnonzero((pid == p) & has_payload)
        if p == 0x1FFF or len(at) < 2:
            continue
        step = np.diff(rows[at, 3].astype(np.int32) & 15) & 15
        twice = (step == 0) & (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(axis=1)
        keep[at[1:][twice]] = False
        jumps += int(((step != 1) & ~twice & (flags[at[1:]] & 0x80 == 0)).sum())
    tables = lambda p: _sections(rows[sel], start[sel]) if (sel := (pid == p) & keep & unit).any() else []
    programs, streams = {}, {}
    for s in tables(0):
        if s[0] == 0:
            programs |= {n: q & 0x1FFF for n, q in struct.iter_unpack(">HH", s[8:-4]) if n}
    for q in sorted(set(programs.values())):
        for s in tables(q):
            i = 12 + (struct.unpack(">H", s[10:12])[0] & 0xFFF)
            while s[0] == 2 and i + 5 <= len(s) - 4:
                kind, es, extra = struct.unpack(">BHH", s[i : i + 5])
                streams[es & 0x1FFF] = kind
                i += 5 + (extra & 0xFFF)
    packets, short = [], 0
    for es in sorted(streams):
        at = np.flatnonzero((pid == es) & keep)
        begins = np.flatnonzero(unit[at])
        if not len(begins):
            continue
        data = rows[at][np.arange(PACKET) >= start[at, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - start[at])])
        for i, j in zip(begins, [*begins[1:], len(at)], strict=True):
            unit_data = data[ends[i] : ends[j]]
            if len(unit_data) < 9 or unit_data[:3] != b"\0\0\1":
                short += 1
                continue
            size, head = struct.unpack(">H", unit_data[4:6])[0], unit_data[8]
            body = unit_data[9 + head : 6 + size if size else None]
            short += bool(size and len(unit_data) < 6 + size)
            t = unit_data[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if unit_data[7] & 0x80 and len(t) == 5 else None
            packets.append((es, pts, bool(flags[at[i]] & 0x40), body, int(index[at[i]]) * PACKET))
    return {"programs": programs, "streams": streams, "packets": packets, "lost": lost, "jumps": jumps, "short": short}


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


MEDIA = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, programs string, streams string, times array<long>, points array<struct<at: long, pts: long>>, lost long, jumps long, short long"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a media column with the text's padded bytes as a transport stream.

    Null counts as empty, an empty text as 64 zero bytes; rows with equal or null doc_id are streams like any others.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch):
                some = batch.slice(i, j - i)
                texts = some.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """The payload and the tables, times, random-access points and error counts of each stream; null media count as empty.

    times: the presentation time of each elementary packet, null where it has none; points: place and time of those
    that a reader can begin with.
    """
    ship(media.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("programs", pa.string()), ("streams", pa.string()), ("times", pa.list_(pa.int64())), ("points", pa.list_(pa.struct([("at", pa.int64()), ("pts", pa.int64())]))), ("lost", pa.int64()), ("jumps", pa.int64()), ("short", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, j in slices(batch, column="media"):
                rows = []
                for r in batch.slice(i, j - i).to_pylist():
                    raw = r["media"] or b""
                    x = demux(raw)
                    rows.append({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload": b"".join(p[3] for p in x["packets"]), "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest(), "programs": ",".join(f"{a}:{b}" for a, b in sorted(x["programs"].items())), "streams": ",".join(f"{a}:{b}" for a, b in sorted(x["streams"].items())), "times": [p[1] for p in x["packets"]], "points": [{"at": p[4], "pts": p[1]} for p in x["packets"] if p[2]], "lost": x["lost"], "jumps": x["jumps"], "short": x["short"]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), READ)


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op8: documents as transport streams in a stored table, read back from it."""
    media = stored(to_media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    back = read_media(media)
    edge = lambda f: F.coalesce(f("times").cast("string"), F.lit(""))
    part = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    feature = F.concat_ws(";", part("programs", F.col("programs")), part("streams", F.col("streams")), part("pes", F.size("times")), F.concat(F.lit("pts="), edge(F.array_min), F.lit("-"), edge(F.array_max)), part("access", F.array_join(F.transform("points", lambda p: p.at.cast("string")), ",")), part("errors", F.col("lost") + F.col("jumps") + F.col("short")))
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
