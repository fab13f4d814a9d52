"""MPEG transport streams in a media column (operator 2).

pack() carries bytes as one program: a program association table, a program map table and one private elementary stream,
whose access units (UNIT bytes each) are PES packets with a presentation timestamp; every KEY_EVERY-th unit is a
random-access point with a clock reference. store() keeps the stream in a column, and beside it its index: for each unit
the timestamp, the number of its first packet and whether it is a random-access point, so that a reader can seek by time
without parsing the stream. unpack() reads the bytes of any such stream back: it parses both tables and
their checksums, counts breaks of the continuity counters, reassembles the PES packets of the first program's first
stream and lists timestamps and random-access points. A break that a discontinuity indicator announces isn't counted. A packet that is sent twice counts once; an adaptation field that
says it is longer than its packet makes the packet damaged: it is counted and has no payload. A unit that ends before its
timestamp has none, and packets before the first unit start, or tables without a start, belong to nothing; no stream, however
damaged, ends the job.

Null texts count as empty. Equal bytes give equal streams. A null stream, or one that has no whole packet, has no payload,
no programs and no units; packets that have lost their sync byte are skipped and counted. Null and repeated doc_ids are
rows like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reckoner.llm.common import flat_text, saved, slices, table

PACKET, UNIT, KEY_EVERY = 188, 16_384, 4
MAP_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
#: Ticks of the 90 kHz clock between units: 25 a second.
TICKS = 3_600
ALIGN = 64


def _crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A table section in a packet of its own, without its packet header."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return (b"\x00" + head + body + _crc32_mpeg(head + body).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


def _tables() -> np.ndarray:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    heads = [bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) for pid in (0, MAP_PID)]
    return np.frombuffer(heads[0] + pat + heads[1] + pmt, np.uint8).reshape(2, PACKET)


_HEAD = _tables()


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def pack(payload: bytes) -> tuple[bytes, list[tuple[int, int, bool]]]:
    """The transport stream of payload, and its index: timestamp, first packet and random access of each unit."""
    parts, counter, index = [_HEAD], 0, []
    for k in range(0, max(1, -(-len(payload) // UNIT))):
        data = payload[k * UNIT : (k + 1) * UNIT]
        pts = k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts) + data
        fields = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if k % KEY_EVERY == 0 else b""
        room = PACKET - 5 - len(fields) if fields else PACKET - 4
        rest = len(pes) - room
        n = 1 + max(0, -(-rest // (PACKET - 4)))
        out = np.empty((n, PACKET), np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        index.append((pts, len(_HEAD) + counter, bool(fields)))
        counter += n
        body = np.frombuffer(pes, np.uint8)
        at, first = 0, 0
        if fields and n > 1:
            out[0, 3] |= 0x20
            out[0, 4] = len(fields)
            out[0, 5 : 5 + len(fields)] = np.frombuffer(fields, np.uint8)
            out[0, 5 + len(fields) :] = body[:room]
            at, first = room, 1
        whole = n - 1 - first
        if whole > 0:
            out[first : n - 1, 4:] = body[at : at + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
            at += whole * (PACKET - 4)
        left, own = len(body) - at, fields if n == 1 else b""
        if left < PACKET - 4 or own:  # the last packet is filled up by its adaptation field
            size = PACKET - 5 - left
            out[-1, 3] |= 0x20
            out[-1, 4] = size
            if size:
                out[-1, 5 : 5 + size] = np.frombuffer((own or b"\x00").ljust(size, b"\xff"), np.uint8)
        out[-1, PACKET - left :] = body[at:]
        parts.append(out)
    return np.concatenate(parts).tobytes(), index


def _sections(packets: np.ndarray, begin: np.ndarray, pid: np.ndarray, start: np.ndarray, want: int) -> list[bytes]:
    """Tables of one pid whose checksums hold; a section may go on in the packets that follow, up to the next that begins one."""
    found, own = [], np.flatnonzero(pid == want)
    heads = np.flatnonzero(begin[own])
    for h, after in zip(heads.tolist(), np.append(heads[1:], len(own)).tolist() if len(heads) else [], strict=True):
        raw = b"".join(packets[k, start[k] :].tobytes() for k in own[h:after])
        if raw:
            raw = raw[1 + raw[0] :]
            size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
            if len(raw) >= size > 11 and _checked(raw[:size]):
                found.append(raw[:size])
    return found


_good: dict[bytes, bool] = {}


def _checked(section: bytes) -> bool:
    """Whether the section's checksum holds; streams repeat their tables, so answers are kept."""
    if section not in _good:
        if len(_good) > 1000:
            _good.clear()
        _good[section] = _crc32_mpeg(section[:-4]) == int.from_bytes(section[-4:], "big")
    return _good[section]


def unpack(stream: bytes | None) -> dict:
    """payload, programs ({number: {pid: type}}), breaks (of continuity), lost (packets without sync), damaged, repeated, pts, starts (first packet of each unit), units (bytes each), key_packets (packet numbers of random-access points)."""
    out = {"payload": b"", "programs": {}, "breaks": 0, "lost": 0, "damaged": 0, "repeated": 0, "pts": [], "starts": [], "units": [], "key_packets": []}
    n = len(stream or b"") // PACKET
    if not n:
        return out
    packets = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    synced = packets[:, 0] == 0x47
    out["lost"] = int(n - synced.sum())
    number = np.flatnonzero(synced)
    packets = packets[synced]
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    begin, control = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3
    field = control & 2 > 0
    start = np.where(control & 1, np.where(field, 5 + packets[:, 4].astype(np.int64), 4), PACKET)
    out["damaged"] = int((start > PACKET).sum())
    start = np.minimum(start, PACKET)
    for pat in _sections(packets, begin, pid, start, 0):
        for k in range(8, len(pat) - 4, 4):
            program, where = int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF
            for pmt in _sections(packets, begin, pid, start, where) if program else []:
                at, streams = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF), {}
                while at < len(pmt) - 4:
                    streams[int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF] = pmt[at]
                    at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
                out["programs"][program] = streams
    pids = [p for s in out["programs"].values() for p in s]
    if not pids:
        return out
    own = (pid == pids[0]) & (control & 1 > 0)
    packets, start, begin, field, number = packets[own], start[own], begin[own], field[own], number[own]
    counter = packets[:, 3].astype(np.int64) & 15
    again = np.append(False, (np.diff(counter) == 0) & (packets[1:] == packets[:-1]).all(1))  # the standard lets a packet be sent twice
    if again.any():
        out["repeated"] = int(again.sum())
        packets, start, begin, field, number, counter = (x[~again] for x in (packets, start, begin, field, number, counter))
    excused = field & (packets[:, 4] > 0) & (packets[:, 5] & 0x80 > 0)  # the stream says that its counter begins anew
    out["breaks"] = int((((np.diff(counter) & 15) != 1) & ~excused[1:]).sum())
    key = field & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0)
    out["key_packets"] = number[key].tolist()
    body = packets[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    heads = (ends - (PACKET - start))[begin].tolist()
    whole = []
    for s, e, at in zip(heads, [*heads[1:], len(body)] if heads else [], number[begin].tolist(), strict=True):
        pes = body[s:e]
        if pes[:3] == b"\x00\x00\x01" and len(pes) >= 9:
            length = int.from_bytes(pes[4:6], "big")
            whole.append(pes[9 + pes[8] : 6 + length if length else None])
            out["units"].append(len(whole[-1]))
            p = pes[9:14]
            if pes[7] & 0x80 and len(p) == 5:
                out["starts"].append(at)
                out["pts"].append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
    out["payload"] = b"".join(whole)
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and index: each text as UTF-8, filled with bytes 0 up to a positive multiple of ALIGN, as a transport stream, and the timestamp, first packet and random access of its units."""

    def run(batches):
        for b in batches:
            data, offsets = flat_text(b.column("text"))
            raw = data.tobytes()
            for first, last in slices(offsets):
                texts = [raw[offsets[k] : offsets[k + 1]] for k in range(first, last)]
                media = [pack(x.ljust(max(ALIGN, -(-len(x) // ALIGN) * ALIGN), b"\x00")) for x in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array([len(x) for x in texts], pa.int64()), pa.array([m for m, _ in media], pa.binary()), pa.array([[dict(zip(("pts", "packet", "random_access"), u, strict=True)) for u in x] for _, x in media], INDEX)], ["doc_id", "n_bytes", "media", "index"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, index array<struct<pts:long,packet:long,random_access:boolean>>")


def features(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, what the payload read back and the stream hold, its timestamps and random-access packets, and index_ok: whether the stored index says the same."""

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part, rows = b.slice(first, 500), []
                for doc_id, n_bytes, media, index in zip(*(part.column(c) for c in ("doc_id", "n_bytes", "media", "index")), strict=True):
                    media = media.as_py()
                    x = unpack(media)
                    payload, media, index = x["payload"], media or b"", index.as_py() or []
                    keys = set(x["key_packets"])
                    stream = ",".join(f"{n}/{pid}/{kind}" for n, s in sorted(x["programs"].items()) for pid, kind in sorted(s.items()))
                    rows.append({
                        "doc_id": doc_id.as_py(), "n_bytes": n_bytes.as_py(), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": f"streams={stream};packets={len(media) // PACKET};units={len(x['units'])};keys={len(x['key_packets'])};last_pts={x['pts'][-1] if x['pts'] else ''};breaks={x['breaks']};lost={x['lost']}",
                        "pts": x["pts"], "key_packets": x["key_packets"],
                        "index_ok": [(u["pts"], u["packet"], u["random_access"]) for u in index] == [(p, k, k in keys) for p, k in zip(x["pts"], x["starts"], strict=True)],
                    })
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, key_packets array<long>, index_ok boolean"
    return stored.mapInArrow(run, kinds)


_long, _str = pa.int64(), pa.string()
SCHEMA = pa.schema([("doc_id", _long), ("n_bytes", _long), ("payload_bytes", _long), ("payload_sha256", _str), ("tail_crc32", _long), ("media_bytes", _long), ("media_sha256", _str), ("feature", _str), ("pts", pa.list_(_long)), ("key_packets", pa.list_(_long)), ("index_ok", pa.bool_())])
INDEX = pa.list_(pa.struct([("pts", _long), ("packet", _long), ("random_access", pa.bool_())]))


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as transport streams with their index in Parquet columns, read back."""
    return features(saved(store(table(spark, sf_dir, "documents")), "media"))
