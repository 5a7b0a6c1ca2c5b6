"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

`parse` reads any MPEG-1/2/2.5 layer I, II or III stream held in a binary column. Frame headers are
found again after damage (a header counts only if the frame after it agrees with it or the stream
ends there); ID3v2, ID3v1 and APEv2 tags, Xing/Info/LAME and VBRI tables are parsed; CRC-16 words
are verified; durations are exact sample counts. `store` writes 8-bit samples losslessly as a layer
I stream: 16 subbands of 12 samples with 8-bit codes make 192 samples a frame. The code 255 is not
allowed in that layer; UTF-8 text never has that byte.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathlens.llm.common import utf8

UNIT = 192
# Fixed values of the format: kbit/s by (MPEG-1?, layer) and index, Hz by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Layer II: bits of allocation by subband for the tables of the standard, as (bits, subbands).
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19))}
SCHEMA = "layer int, version string, sample_rate int, channels int, frames long, samples long, duration_s double, bitrate_mean double, vbr string, vbr_frames long, crc_ok long, crc_bad long, skipped_bytes long, tags string, seek array<long>"


@functools.cache
def _crc_table() -> np.ndarray:
    """CRC-16 of the format: polynomial 0x8005, most significant bit first."""
    table = np.zeros(256, np.uint16)
    for k in range(256):
        x = k << 8
        for _ in range(8):
            x = (x << 1 ^ (0x8005 if x & 0x8000 else 0)) & 0xFFFF
        table[k] = x
    return table


def crc16(rows: np.ndarray, start: int = 0xFFFF) -> np.ndarray:
    """CRC of each row of bytes, all rows at once."""
    table, crc = _crc_table(), np.full(len(rows), start, np.uint16)
    for k in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ table[(crc >> np.uint16(8)) ^ rows[:, k]]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC over header bytes 2-3 and then `bits` bits after the CRC word."""
    crc = 0xFFFF
    body = data[2:4] + data[6 : 6 + (bits + 7) // 8]
    for k in range(16 + bits):
        bit = body[k >> 3] >> (7 - (k & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


def header(word: int) -> dict | None:
    """The fields of a 4-byte frame header, or None if it can't be one. size is 0 in free format."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate, bitrate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate == 3 or bitrate == 15 or word & 3 == 2:
        return None
    first, pad = version == 3, word >> 9 & 1
    hz, kbit, mode = RATES[version][rate], BITRATES[first, layer][bitrate], word >> 6 & 3
    size = (12000 * kbit // hz + pad) * 4 if layer == 1 else (144000 if first or layer == 2 else 72000) * kbit // hz + pad
    return {
        "version": version, "layer": layer, "crc": not word >> 16 & 1, "kbit": kbit, "hz": hz, "pad": pad, "mode": mode, "extension": word >> 4 & 3,
        "channels": 1 if mode == 3 else 2, "samples": 384 if layer == 1 else 1152 if first or layer == 2 else 576, "size": size if kbit else 0, "kind": word & 0xFFFE0C00,
    }


_header = functools.lru_cache(4096)(header)


def _side(h: dict) -> int:
    return (17 if h["mode"] == 3 else 32) if h["version"] == 3 else 9 if h["mode"] == 3 else 17


def protected_bits(h: dict, frame: bytes) -> int:
    """Bits after the CRC word that it protects."""
    bound = min(32, 4 * (h["extension"] + 1)) if h["mode"] == 1 else 32
    if h["layer"] == 3:
        return 8 * _side(h)
    if h["layer"] == 1:
        return 4 * (bound * h["channels"] + (32 - bound)) if h["channels"] == 2 else 128
    each = h["kbit"] // h["channels"]
    name = "lsf" if h["version"] != 3 else ("c" if h["hz"] != 32000 else "d") if each <= 48 and each else "a" if each <= 80 or h["hz"] == 48000 else "b"
    widths = [w for w, n in ALLOCATION[name] for _ in range(n)]
    whole, at, chosen = int.from_bytes(frame[6:], "big"), 0, 0
    length = 8 * len(frame[6:])
    for band, width in enumerate(widths):
        for _ in range(1 if band >= bound else h["channels"]):
            value = whole >> (length - at - width) & ((1 << width) - 1)
            at += width
            chosen += 2 * bool(value) * (h["channels"] if band >= bound else 1)
    return at + chosen


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(coding, "replace").replace("\0", "=", raw[1:].decode(coding, "replace").rstrip("\0").count("\0")).rstrip("\0")


def tags(data: bytes) -> tuple[int, int, list[tuple[str, str]]]:
    """(first byte after the leading tags, end of the audio, (name, value) of the tags)."""
    start, end, found = 0, len(data), []
    while data[start : start + 3] == b"ID3" and end - start >= 10 and data[start + 3] < 0xFF:
        major, flags, size = data[start + 3], data[start + 5], _synchsafe(data[start + 6 : start + 10])
        at, stop = start + 10, min(start + 10 + size, end)
        if flags & 0x40 and major >= 3 and at + 4 <= stop:
            at += _synchsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
        name, step = (3, 6) if major == 2 else (4, 10)
        while at + step <= stop and data[at] >= 0x30:
            length = int.from_bytes(data[at + 3 : at + 6], "big") if major == 2 else _synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            if data[at : at + 1] == b"T":
                found.append((data[at : at + name].decode("latin-1"), _text(data[at + step : at + step + length])))
            at += step + length
        start = stop + 10 * bool(flags & 0x10)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        last = data[end - 128 : end]
        found += [(n, v) for n, a, b in (("id3v1.title", 3, 33), ("id3v1.artist", 33, 63), ("id3v1.album", 63, 93), ("id3v1.year", 93, 97)) if (v := last[a:b].split(b"\0")[0].decode("latin-1").strip())]
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        at = end - size
        if at >= start:
            for _ in range(count):
                if at + 8 > end - 32:
                    break
                length = int.from_bytes(data[at : at + 4], "little")
                key, _, rest = data[at + 8 : end - 32].partition(b"\0")
                found.append((f"ape.{key.decode('latin-1')}", rest[:length].decode("utf-8", "replace")))
                at += 8 + len(key) + 1 + length
            end -= size + 32 * bool(flags >> 31)
    return min(start, end), max(start, end), found


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0


def _free_size(data: bytes, at: int, end: int, h: dict) -> int:
    """The size of a free-format frame without padding: the distance to the next header of its kind."""
    for nxt in range(at + 24, min(end - 3, at + 4608)):
        if data[nxt] == 0xFF and (n := _header(_word(data, nxt))) and n["kind"] == h["kind"] and not n["kbit"]:
            return nxt - at - h["pad"] * (4 if h["layer"] == 1 else 1)
    return 0


def frames(data: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray, dict | None, int]:
    """(offsets and sizes of the frames, header of the first, bytes skipped between start and end)."""
    raw = np.frombuffer(data, np.uint8)
    offsets, sizes, first, skipped, at, free = [], [], None, 0, start, 0
    synced = False
    while at + 4 <= end:
        h = _header(_word(data, at))
        size = 0
        if h and (first is None or h["kind"] == first["kind"]):
            size = h["size"]
            if not size:
                free = free or _free_size(data, at, end, h)
                size = free + h["pad"] * (4 if h["layer"] == 1 else 1) if free else 0
        if size and at + size <= end and not synced and at + size < end:
            n = _header(_word(data, at + size))
            size = size if n and n["kind"] == h["kind"] else 0
        if not size or at + size > end:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped, at = skipped + nxt - at, nxt
            continue
        first, synced = first or h, True
        # A run of frames with one and the same header is taken at once.
        most = (end - at) // size
        heads = raw[at : at + most * size].reshape(most, size)[:, :4]
        run = int((~(heads == heads[0]).all(axis=1)).argmax()) or most
        offsets.append(at + size * np.arange(run))
        sizes.append(np.full(run, size))
        at += size * run
    skipped += max(0, end - at)
    none = np.zeros(0, np.int64)
    return np.concatenate(offsets or [none]), np.concatenate(sizes or [none]), first, skipped


def table(data: bytes, at: int, size: int, h: dict) -> dict | None:
    """The variable-bitrate table in a frame: Xing or Info after the side data, or VBRI."""
    body = 4 + 2 * h["crc"] + (_side(h) if h["layer"] == 3 else 16 * h["channels"] if h["layer"] == 1 else 0)
    for begin in dict.fromkeys((at + body, at + 4 + _side(h))):
        name = data[begin : begin + 4]
        if name in (b"Xing", b"Info"):
            flags, k, out = _word(data, begin + 4), begin + 8, {"name": name.decode(), "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key], k = _word(data, k), k + 4
            if flags & 4:
                out["toc"], k = list(data[k : k + 100]), k + 100
            k += 4 * bool(flags & 8)
            if data[k : k + 4] in (b"LAME", b"Lavf", b"Lavc") and k + 24 <= at + size:
                packed = int.from_bytes(data[k + 21 : k + 24], "big")
                out["delay"], out["padding"] = packed >> 12, packed & 0xFFF
            return out
    begin = at + 36
    if data[begin : begin + 4] == b"VBRI" and begin + 26 <= at + size:
        total, count, entries, scale, width, per = struct.unpack(">IIHHHH", data[begin + 10 : begin + 26])
        toc = [int.from_bytes(data[begin + 26 + k * width : begin + 26 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"name": "VBRI", "frames": count, "bytes": total, "toc": toc, "per": per, "delay": 0, "padding": 0}
    return None


def parse(data: bytes) -> dict:
    """What SCHEMA names, of one stream. Empty or foreign data has no frames and layer None.

    seek holds the byte offset of every audio frame; a frame's time is its number times the samples
    a frame. A leading table frame is no audio. LAME's delay and padding are taken off the samples.
    """
    start, end, named = tags(data)
    offsets, sizes, h, skipped = frames(data, start, end)
    out = dict.fromkeys((f.split()[0] for f in SCHEMA.split(", ")), None) | {"frames": 0, "samples": 0, "duration_s": 0.0, "crc_ok": 0, "crc_bad": 0, "skipped_bytes": skipped, "tags": "\n".join(f"{k}={v}" for k, v in named), "seek": []}
    if not h:
        return out
    vbr = table(data, int(offsets[0]), int(sizes[0]), h)
    if h["crc"]:
        ok = 0
        raw = np.frombuffer(data, np.uint8)
        if h["layer"] != 2 and h["mode"] != 1:
            width = protected_bits(h, b"") // 8
            cover = raw[offsets[:, None] + np.r_[2, 3, 6 : 6 + width]]
            ok = int((crc16(cover) == (raw[offsets + 4].astype(np.uint16) << 8 | raw[offsets + 5])).sum())
        else:
            for at, size in zip(offsets.tolist(), sizes.tolist()):
                frame = data[at : at + size]
                ok += crc16_bits(frame, protected_bits(_header(_word(data, at)), frame)) == int.from_bytes(frame[4:6], "big")
        out |= {"crc_ok": ok, "crc_bad": len(offsets) - ok}
    audio = offsets[1:] if vbr else offsets
    samples = max(0, len(audio) * h["samples"] - (vbr["delay"] + vbr["padding"] if vbr else 0))
    spent = int((sizes[1:] if vbr else sizes).sum())
    return out | {
        "layer": h["layer"], "version": {3: "1", 2: "2", 0: "2.5"}[h["version"]], "sample_rate": h["hz"], "channels": h["channels"], "frames": len(audio), "samples": samples, "duration_s": samples / h["hz"],
        "bitrate_mean": 8.0 * spent * h["hz"] / (len(audio) * h["samples"]) if len(audio) else None, "vbr": vbr["name"] if vbr else None, "vbr_frames": vbr["frames"] if vbr else None, "seek": audio.tolist(),
    }


def seek(parsed: dict, sample: int) -> int | None:
    """The byte offset of the frame that holds a sample."""
    per = {1: 384, 2: 1152}.get(parsed["layer"], 1152 if parsed["version"] == "1" else 576)
    return parsed["seek"][sample // per] if 0 <= sample // per < len(parsed["seek"]) else None


# The stored form: MPEG-1 layer I, 32 kHz, 160 kbit/s, mono, with CRC: 240 bytes a frame.
_HEAD = bytes((0xFF, 0xFE, 0x58, 0xC0))
_FRAME, _ALLOCATED, _BODY = 240, bytes([0x77] * 8 + [0] * 8), 4 + 2 + 16 + 12


def _id3(values: list[tuple[str, str]]) -> bytes:
    body = b"".join(name.encode() + struct.pack(">IH", len(text) + 1, 0) + b"\0" + text.encode("latin-1") for name, text in values)
    return b"ID3\x03\0\0" + bytes((len(body) >> s) & 0x7F for s in (21, 14, 7, 0)) + body


@functools.cache
def _heads() -> tuple[bytes, bytes]:
    """Header, CRC and allocation of a silent frame and of one with samples."""
    out = []
    for allocation in (bytes(16), _ALLOCATED):
        crc = int(crc16(np.frombuffer(_HEAD[2:] + allocation, np.uint8)[None])[0])
        out.append(_HEAD + crc.to_bytes(2, "big") + allocation)
    return out[0], out[1]


def store(payload: bytes, note: str = "") -> bytes:
    """A stream whose sample codes are the bytes of payload, a positive multiple of UNIT without byte 255."""
    if not payload or len(payload) % UNIT or b"\xff" in payload:
        raise ValueError("a payload is a positive multiple of 192 bytes, none of them 255")
    silent, sounding = _heads()
    n = len(payload) // UNIT
    grid = np.zeros((n, _FRAME), np.uint8)
    grid[:, : len(sounding)] = np.frombuffer(sounding, np.uint8)
    grid[:, _BODY : _BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = (n + 1) * _FRAME
    toc = bytes(min(255, 256 * (_FRAME * (1 + k * n // 100)) // total) for k in range(100))
    info = (silent + b"Info" + struct.pack(">III", 7, n, total) + toc).ljust(_FRAME, b"\0")
    return _id3([("TLEN", str(n * 384 * 1000 // 32000)), ("TXXX", f"note\0{note}")]) + info + grid.tobytes()


def samples8(data: bytes, parsed: dict) -> bytes:
    """The sample codes of a stream that `store` wrote, in order."""
    if not parsed["frames"]:
        return b""
    at = np.asarray(parsed["seek"])
    raw = np.frombuffer(data, np.uint8)
    if (np.diff(at) == _FRAME).all():
        return raw[at[0] : at[0] + len(at) * _FRAME].reshape(-1, _FRAME)[:, _BODY : _BODY + UNIT].tobytes()
    return raw[at[:, None] + np.arange(_BODY, _BODY + UNIT)].tobytes()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        rows = [parse(bytes(data[a:b])) for a, b in zip(offsets, offsets[1:])]
        kinds = dict(zip(names, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in names)], ["id", *names])


def annotate(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, the columns of SCHEMA) for each stream. Null media counts as empty and has no frames."""
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(media[id_col].alias("id"), media[media_col].cast("binary").alias("media")).mapInArrow(_parsed, f"id {kind}, {SCHEMA}")


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        rows = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            n = b - a
            payload = bytes(data[a:b]).ljust(max(UNIT, -(-n // UNIT) * UNIT), b" ")
            stored = store(payload, str(n))
            parsed = parse(stored)
            back = samples8(stored, parsed)
            codes = np.frombuffer(back, np.uint8)
            feature = f"mpeg{parsed['version']}-layer{parsed['layer']};hz={parsed['sample_rate']};frames={parsed['frames']};samples={parsed['samples']};vbr={parsed['vbr']}:{parsed['vbr_frames']};crc={parsed['crc_ok']}/{parsed['crc_ok'] + parsed['crc_bad']};skipped={parsed['skipped_bytes']};seek={parsed['seek'][0]}-{parsed['seek'][-1]};sum={int(codes.sum(dtype=np.int64))};peak={int(codes.max())};steps={int(np.count_nonzero(codes[1:] != codes[:-1]))}"
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, parsed["duration_s"], parsed["seek"]))
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "seek"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text, as UTF-8 padded with spaces to a positive multiple of 192 bytes, as a stream."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(_stored, f"id {kind}, media binary")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        made = [store(bytes(data[a:b]).ljust(max(UNIT, -(-(b - a) // UNIT) * UNIT), b" "), str(b - a)) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "media"])


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stream back and describes both, in one pass without a shuffle.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    duration_s, seek), seek being the byte offset of every frame. A null text counts as empty: one frame of spaces. Equal texts give equal values;
    repeated rows stay. A task holds one Arrow batch and one stream at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        _round_trip, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, seek array<long>"
    )
