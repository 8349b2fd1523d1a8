"""Pictures as a source and a sink: formats, sizes and orientations from headers, and PNG pixels both ways (zlib is all it takes).

Other codecs aren't at hand here; their pictures have a size and an orientation, but no pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed value: samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bytes of a file that are read for its header.
HEAD = 256 << 10


def exif_orientation(tiff: bytes) -> int:
    """Tag 274 of the first directory of a TIFF block; 1 where it is missing or broken."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 10:
        return 1
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return 1
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        if struct.unpack_from(order + "H", tiff, entry)[0] == 274:
            value = struct.unpack_from(order + "H", tiff, entry + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def jpeg_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and orientation, from the segments before the picture itself."""
    at, turned = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turned = exif_orientation(data[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h, turned
        at += 2 + size
    raise ValueError("no frame in the header")


def webp_header(data: bytes) -> tuple[int, int, int]:
    kind = data[12:16]
    if kind == b"VP8 ":
        w, h = struct.unpack_from("<HH", data, 26)
        return w & 0x3FFF, h & 0x3FFF, 1
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, 1
    raise ValueError("not a WebP picture")


def header(data: bytes) -> tuple[str, int, int, int]:
    """Format, width, height (as stored) and orientation of a picture; ValueError for anything else."""
    try:
        if data.startswith(PNG):
            return "png", *struct.unpack_from(">II", data, 16), 1
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack_from("<HH", data, 6), 1
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return "bmp", w, abs(h), 1
        if data[:2] == b"\xff\xd8":
            return "jpeg", *jpeg_header(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return "webp", *webp_header(data)
    except struct.error:
        raise ValueError("the header ends early") from None
    raise ValueError("not a picture")


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned as an orientation from 1 to 8 asks for."""
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
    rows, columns = {2: (1, -1), 3: (-1, -1), 4: (-1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}.get(orientation, (1, 1))
    return pixels[::rows, ::columns]


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG without its filter."""
    if kind == 0:
        return line
    if kind == 1:
        return line.reshape(-1, step).cumsum(0, dtype=np.uint8).ravel() if len(line) % step == 0 else np.array(walked(1, line, above, step))
    if kind == 2:
        return line + above
    if kind in (3, 4):
        return np.array(walked(kind, line, above, step), np.uint8)
    raise ValueError("unknown filter")


def walked(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> list[int]:
    """Filters that need the byte just made: byte by byte."""
    up, out = above.tolist(), line.tolist()
    for k, value in enumerate(out):
        left, corner = (out[k - step], up[k - step]) if k >= step else (0, 0)
        if kind == 4:
            near = left + up[k] - corner
            guess = min((abs(near - left), 0, left), (abs(near - up[k]), 1, up[k]), (abs(near - corner), 2, corner))[2]
        else:
            guess = (left + up[k]) // 2 if kind == 3 else left
        out[k] = value + guess & 255
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) samples of 8 bits, palettes resolved; interlaced pictures are refused."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    at, body, palette = 8, [], None
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is broken")
        if name == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    if interlaced or colour not in SAMPLES:
        raise ValueError("not a kind of PNG that is read here")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    bits = SAMPLES[colour] * depth
    line = (w * bits + 7) // 8
    rows = raw[: h * (line + 1)].reshape(h, line + 1)
    above, lines = np.zeros(line, np.uint8), []
    for row in rows:
        above = unfiltered(int(row[0]), row[1:], above, max(1, bits // 8))
        lines.append(above)
    flat = np.stack(lines)
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        each = np.unpackbits(flat, axis=1).reshape(h, -1, depth)
        flat = (each * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)[:, :w]
        flat = flat if colour == 3 else (flat.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = flat[:, : w * SAMPLES[colour]].reshape(h, w, SAMPLES[colour])
    return palette[pixels[..., 0]] if colour == 3 else pixels


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width[, channels]) samples of 8 bits; each line keeps what differs from the one above."""
    p = pixels if pixels.ndim == 3 else pixels[..., None]
    h, w, n = p.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    flat = np.ascontiguousarray(p, np.uint8).reshape(h, w * n)
    lines = np.concatenate([np.full((h, 1), 2, np.uint8), np.diff(flat, axis=0, prepend=np.zeros((1, w * n), np.uint8))], 1)

    def chunk(name: bytes, part: bytes) -> bytes:
        return len(part).to_bytes(4, "big") + name + part + zlib.crc32(name + part).to_bytes(4, "big")

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def heads(rows: DataFrame, most: int = HEAD, path: str = "path") -> DataFrame:
    """Adds `head`, the first bytes of each file, read where the task runs; the rest of a file is never read. Null for a file
    that can't be opened. Paths are those of file systems that pyarrow opens (local, HDFS, S3 and the like)."""
    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            out = []
            for p in pdf[path]:
                try:
                    system, inner = fs.FileSystem.from_uri(p)
                    with system.open_input_file(inner) as f:
                        out.append(f.read(min(most, f.size())))
                except (OSError, ValueError):
                    out.append(None)
            yield pdf.assign(head=out)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{ddl}, head binary")


def sized(rows: DataFrame, head: str = "head") -> DataFrame:
    """Adds format, w, h (as shown, after the orientation), orientation and error of pictures whose first bytes are in a column."""
    def one(data):
        try:
            kind, w, h, turned = header(bytes(data))
            return kind, *((h, w) if turned >= 5 else (w, h)), turned, None
        except (ValueError, TypeError) as e:
            return None, None, None, None, str(e)

    def run(batches):
        for pdf in batches:
            found = pd.DataFrame([one(d) for d in pdf[head]], columns=["format", "w", "h", "orientation", "error"], dtype=object)
            yield pd.concat([pdf[kept].reset_index(drop=True), found], axis=1)

    kept = [c for c in rows.columns if c != head]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != head)
    return rows.mapInPandas(run, f"{ddl}format string, w long, h long, orientation long, error string")


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, format, w, h, orientation and error of the pictures of a folder; only headers are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    return sized(heads(files))


def pixels(rows: DataFrame, content: str = "content") -> DataFrame:
    """Replaces PNG bytes by w, h, channels and samples (bytes row by row); null for what can't be read."""
    def run(batches):
        for pdf in batches:
            out = []
            for data in pdf[content]:
                try:
                    p = decode_png(bytes(data))
                    out.append((p.shape[1], p.shape[0], p.shape[2], p.tobytes()))
                except (ValueError, TypeError):
                    out.append((None, None, None, None))
            yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame(out, columns=["w", "h", "channels", "samples"], dtype=object)], axis=1)

    kept = [c for c in rows.columns if c != content]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != content)
    return rows.mapInPandas(run, f"{ddl}w long, h long, channels long, samples binary")


def png(rows: DataFrame, px: str = "px", width: int = 8) -> DataFrame:
    """Replaces a flat array of grey levels by the bytes of a PNG, rounded half to even."""
    def run(batches):
        for pdf in batches:
            made = [encode_png(np.rint(np.asarray(p, float)).clip(0, 255).astype(np.uint8).reshape(-1, width)) for p in pdf[px]]
            yield pdf[kept].assign(content=made)

    kept = [c for c in rows.columns if c != px]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != px)
    return rows.mapInPandas(run, f"{ddl}content binary")
