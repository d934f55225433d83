"""Media columns in progressive JPEG (SOF2, Huffman coded, 8 bits).

decode() reads any such file of one or three components: the scans of spectral selection and successive approximation
accumulate in coefficient arrays; these are dequantised, inverse-transformed in numpy, chroma is upsampled by
repetition, and the result is a full-resolution RGB tensor (height, width, 3).  Scans whose codes are of one length,
as encode_payload() writes them, are read by vectorised steps of the same decoder.

encode_payload() stores bytes losslessly in the unit of the format, the quantised coefficient: each byte b is the AC
coefficient 256 + b of a 4:2:0 image, with DC 0.  Scans: DC, then for each component the bands 1-5 and 6-63 without
their last bit, then that bit; a comment segment holds the payload's length.

Edge cases.  Null and empty texts are 576 filler bytes.  Texts of any length fit (images are 16 pixels wide up to
65520 lines, then wider).  Equal texts give equal bytes.  Repeated rows are stored each; other columns are not read.
Damaged files raise ValueError in decode().
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import store

UNIT, FILL = 576, 255
MAX_MCU_ROWS = 65535 // 16
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each zigzag place."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def inverse_transform() -> np.ndarray:
    """The matrix that takes 64 coefficients in zigzag order to 64 samples."""
    x, u = np.arange(8), np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1)[None, :] / 2
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


INVERSE = inverse_transform()


class Bits:
    """Bits of one entropy-coded segment; past its end stand zeros, a few of which a reader may see."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits) + 64:
            raise ValueError("entropy-coded data ends early")
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out * 2 + b
        out <<= max(0, self.at + n - len(self.bits)) if n else 0
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise ValueError("entropy-coded data ends early")
        self.at += n
        return self.bits[self.at - n : self.at]


class Codes:
    """A Huffman table: symbols by (length, code)."""

    def __init__(self, lengths: bytes, symbols: bytes) -> None:
        self.symbols: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for n, many in enumerate(lengths, 1):
            for _ in range(many):
                self.symbols[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code *= 2
        self.only = symbols[0] if len(symbols) == 1 and lengths[0] == 1 else None

    def read(self, bits: Bits) -> int:
        code = 0
        for n in range(1, 17):
            code = code * 2 + bits.take(1)
            found = self.symbols.get((n, code))
            if found is not None:
                return found
        raise ValueError("no such code")


def extended(value: int, size: int) -> int:
    return value if not size or value >= 1 << (size - 1) else value - (1 << size) + 1


def dc_scan(bits: Bits, blocks: list[tuple[np.ndarray, int, int]], codes: list[Codes | None], high: int, low: int, last: list[int]) -> None:
    """blocks: (coefficients, row of the block, component) in scan order."""
    if high:
        for (c, row, _), b in zip(blocks, bits.many(len(blocks)).tolist(), strict=True):
            if b:
                c[row, 0] |= 1 << low
        return
    for c, row, k in blocks:
        size = codes[k].read(bits)
        last[k] += extended(bits.take(size), size)
        c[row, 0] = last[k] << low


def ac_first(bits: Bits, c: np.ndarray, rows: np.ndarray, codes: Codes, start: int, end: int, low: int) -> None:
    width = end - start + 1
    if codes.only is not None and 0 < codes.only < 16:  # every coefficient is there, in codes of one length
        size = codes.only
        raw = bits.many(len(rows) * width * (1 + size)).reshape(-1, 1 + size)
        if size == 8:
            value = np.packbits(raw[:, 1:], axis=1)[:, 0].astype(np.int32)
        else:
            value = (raw[:, 1:].astype(np.int32) << np.arange(size - 1, -1, -1)).sum(1)
        value = np.where(value < 1 << (size - 1), value - (1 << size) + 1, value)
        c[rows[0] : rows[-1] + 1, start : end + 1] = (value << low).reshape(-1, width)
        return
    run = 0
    for row in rows:
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            zeros, size = divmod(codes.read(bits), 16)
            if size:
                k += zeros
                if k > end:
                    raise ValueError("a coefficient outside its band")
                c[row, k] = extended(bits.take(size), size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + bits.take(zeros)
                break


def ac_refine(bits: Bits, c: np.ndarray, rows: np.ndarray, codes: Codes, start: int, end: int, low: int) -> None:
    one = 1 << low

    def correct(row: int, k: int) -> None:
        if bits.take(1) and not abs(c[row, k]) & one:
            c[row, k] += one if c[row, k] > 0 else -one

    run, i, n = 0, 0, len(rows)
    while i < n:
        row, k = rows[i], start
        if not run:
            while k <= end:
                zeros, size = divmod(codes.read(bits), 16)
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= end:
                    if c[row, k]:
                        correct(row, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        c[row, k] = value
                        k += 1
                        break
                    k += 1
            if not run:
                i += 1
                continue
        many = min(run, n - i)
        if k == start and rows[i + many - 1] - row == many - 1:  # blocks of a run have correction bits only
            part = c[row : row + many, start : end + 1]
            known = part != 0
            flat = part[known]
            got = bits.many(len(flat)).astype(bool)
            part[known] = flat + np.where(got & (np.abs(flat) & one == 0), np.sign(flat) * one, 0)
            i, run = i + many, run - many
            continue
        for j in range(k, end + 1):
            if c[row, j]:
                correct(row, j)
        i, run = i + 1, run - 1


def read(data: bytes) -> dict:
    """The frame of a progressive JPEG with the coefficients of each component (blocks in rows, zigzag columns)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, codes, frame, restart, comments = 2, {}, {}, None, 0, []
    while at < len(data):
        if data[at] != 255:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, name = divmod(body[0], 16)
                n = 64 * (1 + wide)
                quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise ValueError("only 8 bits of one or three components")
            parts = [(body[6 + 3 * i], *divmod(body[7 + 3 * i], 16), body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
            mcus = (-(-height // (8 * vmax)), -(-width // (8 * hmax)))
            frame = {"height": height, "width": width, "hmax": hmax, "vmax": vmax, "mcus": mcus, "parts": []}
            for name, h, v, q in parts:
                frame["parts"].append({"name": name, "h": h, "v": v, "q": q, "across": mcus[1] * h, "rows": -(-(-(-height * v // vmax)) // 8), "cols": -(-(-(-width * h // hmax)) // 8), "c": np.zeros((mcus[0] * v * mcus[1] * h, 64), np.int32)})
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not progressive")
        elif marker == 0xDA:
            found = SCAN_END.search(data, at)
            if not found:
                raise ValueError("no end of a scan")
            stop = found.start()
            scan(frame, codes, body, data[at:stop], restart)
            at = stop
    if frame is None:
        raise ValueError("no frame")
    return frame | {"quant": quant, "comments": comments}


def segments(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers."""
    out, since, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[since:at])
            since = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[since:]]


def scan(frame: dict, codes: dict, head: bytes, data: bytes, restart: int) -> None:
    n = head[0]
    chosen = [(next(p for p in frame["parts"] if p["name"] == head[1 + 2 * i]), *divmod(head[2 + 2 * i], 16)) for i in range(n)]
    start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    pieces = segments(data) if restart else [data]
    if n == 1:
        p = chosen[0][0]
        rows = (np.arange(p["rows"])[:, None] * p["across"] + np.arange(p["cols"])[None, :]).reshape(-1)
        units = [rows[i : i + restart] for i in range(0, len(rows), restart)] if restart else [rows]
    else:
        units = [range(i, min(i + restart, frame["mcus"][0] * frame["mcus"][1])) for i in range(0, frame["mcus"][0] * frame["mcus"][1], restart)] if restart else [range(frame["mcus"][0] * frame["mcus"][1])]
    for piece, unit in zip(pieces, units, strict=False):
        bits = Bits(piece)
        if start:
            p, _, ac = chosen[0]
            (ac_refine if high else ac_first)(bits, p["c"], unit, codes[16 + ac], start, end, low)
            continue
        tables = [codes.get(d) for _, d, _ in chosen]
        many = len(unit) if n == 1 else len(unit) * sum(p["h"] * p["v"] for p, _, _ in chosen)
        still = not bits.bits[:many].any() if high else all(t is not None and t.only == 0 for t in tables)
        if still:  # no bit is set, or no difference is there
            bits.many(many)
            continue
        if n == 1:
            blocks = [(chosen[0][0]["c"], int(r), 0) for r in unit]
        else:
            blocks = [(p["c"], (m // frame["mcus"][1] * p["v"] + y) * p["across"] + m % frame["mcus"][1] * p["h"] + x, k) for m in unit for k, (p, _, _) in enumerate(chosen) for y in range(p["v"]) for x in range(p["h"])]
        dc_scan(bits, blocks, tables, high, low, [0] * n)


def rgb(frame: dict) -> np.ndarray:
    """The full-resolution RGB tensor of read()'s coefficients."""
    planes = []
    for p in frame["parts"]:
        samples = (p["c"] * frame["quant"][p["q"]]).astype(np.float32) @ INVERSE
        samples = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)
        down = len(samples) // p["across"]
        plane = samples.reshape(down, p["across"], 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, p["across"] * 8)
        plane = plane.repeat(frame["vmax"] // p["v"], 0).repeat(frame["hmax"] // p["h"], 1)
        planes.append(plane[: frame["height"], : frame["width"]])
    if len(planes) == 1:
        return np.stack([planes[0]] * 3, 2)
    y, cb, cr = planes[0].astype(np.float32), planes[1].astype(np.float32) - 128, planes[2].astype(np.float32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(x), 0, 255)
    return out


def decode(data: bytes) -> np.ndarray:
    return rgb(read(data))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def entropy(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled with ones, with zeros after bytes of 255."""
    spare = -len(bits) % 8
    raw = np.packbits(np.concatenate([bits, np.ones(spare, np.uint8)]) if spare else bits).tobytes()
    return raw.replace(b"\xff", b"\xff\x00")


def scan_head(names: list[int], start: int, end: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(names), *[x for n in names for x in (n, 0)], start, end, high << 4 | low]))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload in its coefficients."""
    mcus = -(-len(payload) // (63 * 6))
    across = -(-mcus // MAX_MCU_ROWS)
    down = -(-mcus // across)
    per = [across * down * n for n in (4, 1, 1)]
    values = np.full(sum(per) * 63, FILL, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(segment(0xC4, bytes([0, 1, *[0] * 15, 0]) + bytes([0x10, 1, *[0] * 15, 8])))
    nothing = np.zeros(sum(per), np.uint8)
    out += [scan_head([1, 2, 3], 0, 0, 0, 1), entropy(nothing), scan_head([1, 2, 3], 0, 0, 1, 0), entropy(nothing)]
    parts, at = [], 0
    for n in per:
        parts.append(values[at : at + n * 63].reshape(n, 63))
        at += n * 63
    for start, end in ((1, 5), (6, 63)):
        for name, v in enumerate(parts, 1):
            half = (v[:, start - 1 : end] >> 1 | 128).reshape(-1, 1)
            bits = np.zeros((len(half), 9), np.uint8)
            bits[:, 1:] = np.unpackbits(half, axis=1)
            out += [scan_head([name], start, end, 0, 1), entropy(bits.reshape(-1))]
    out.append(segment(0xC4, bytes([0x10, 0, 0, 0, 15, *[0] * 12]) + bytes(n << 4 for n in range(15))))
    for name, v in enumerate(parts, 1):
        bits = []
        for i in range(0, len(v), 32767):
            last = (v[i : i + 32767] & 1).reshape(-1)
            run = len(last) // 63
            n = run.bit_length() - 1
            head = f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")
            bits += [np.array([int(b) for b in head], np.uint8), last]
        out += [scan_head([name], 1, 63, 1, 0), entropy(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(frame: dict) -> bytes:
    """The payload that encode_payload() stored, from read()'s coefficients."""
    size = int(next(c for c in frame["comments"] if c.startswith(b"payload ")).split()[1])
    values = np.concatenate([p["c"][:, 1:].reshape(-1) for p in frame["parts"]])[:size]
    return (values - 256).astype(np.uint8).tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes([FILL]) * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, height, width, feature and, if
    asked for, media (the JPEG) and rgb (the tensor's bytes)."""
    fields = {"id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "height": pa.int32(), "width": pa.int32(), "feature": pa.string()}
    if with_media:
        fields |= {"media": pa.binary(), "rgb": pa.binary()}

    def row(name, text):
        raw = text or b""
        media = encode_payload(padded(raw))
        frame = read(media)
        back, image = payload_of(frame), rgb(frame)
        means = image.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (image.shape[0] * image.shape[1])
        feature = f"{image.shape[0]}x{image.shape[1]}x3:{zlib.crc32(image.tobytes()):08x}:" + ":".join(map(str, means.tolist()))
        out = [name, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), *image.shape[:2], feature]
        return [*out, media, image.tobytes()] if with_media else out

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64 if with_media else 1024):
                part = batch.slice(lo, 64 if with_media else 1024)
                rows = [row(i.as_py(), t.as_py()) for i, t in zip(part.column(0), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))

    names = {"int64": "long", "int32": "int"}
    schema = ", ".join(f"{k} {names.get(str(v), str(v))}" for k, v in fields.items())
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def op10_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    return media_column(store.table(spark, sf_dir, "documents"), with_media=False).withColumnRenamed("id", "doc_id")
