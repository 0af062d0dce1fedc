"""GIF media columns: lossless storage of bytes as timed frames, LZW decoding, and colour histograms.

The writer stores one byte a pixel, as table-coded LZW whose codes grow from 9 to 12 bits. Index 0 (padding) is
transparent; every second frame is interlaced and brings a palette of its own; disposal changes from frame to
frame. The reader decodes any LZW stream, interlacing, local palettes, disposal and transparency. Decoding copies
earlier output (an LZW entry is a range of what is already written), so all bytes of a stretch between clear codes
resolve at once by pointer doubling.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import cut

#: Pixels of a row, rows of a frame at most, and hundredths of a second that a frame shows.
WIDTH, ROWS, DELAY = 64, 1024, 10
CLEAR, FULL = 256, 4096
#: Levels of each colour channel in a histogram.
LEVELS = 4


_PLACES = np.arange(16)


def grey_palette() -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


def warm_palette() -> np.ndarray:
    """The palette of every second frame: from blue to red over equal greens."""
    x = np.arange(256, dtype=np.uint8)
    return np.stack([x, np.minimum(x, 255 - x), 255 - x], 1)


def lzw_encode(pixels: bytes) -> bytes:
    """An LZW stream of minimum code size 8; a clear code follows each full table."""
    codes, table, entry, prefix = [CLEAR], {}, CLEAR + 2, pixels[0]
    known, add = table.get, codes.append
    for c in pixels[1:]:
        k = prefix << 8 | c
        prefix = known(k)
        if prefix is None:
            add(k >> 8)
            if entry < FULL:
                table[k] = entry
                entry += 1
            else:
                add(CLEAR)
                table.clear()
                entry = CLEAR + 2
            prefix = c
    codes += [prefix, CLEAR + 1]
    x = np.array(codes)
    after = np.flatnonzero(x == CLEAR)
    number = np.arange(len(x)) - 1  # of a code after its clear code
    number[1:] -= after[np.searchsorted(after, np.arange(1, len(x)), "left") - 1]
    width = np.minimum(np.frexp(np.maximum(257 + number, 257))[1], 12)
    bits = np.unpackbits(x.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[_PLACES < width[:, None]], bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    """Data in blocks of at most 255 bytes, each after its length, and the empty block."""
    n = len(data) // 255 * 255
    full = np.frombuffer(data[:n], np.uint8).reshape(-1, 255)
    out = np.insert(full, 0, 255, axis=1).tobytes()
    return out + (bytes([len(data) - n]) + data[n:] if len(data) > n else b"") + b"\0"


def interlaced(h: int) -> np.ndarray:
    """The order in which an interlaced image of h rows is stored."""
    return np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold payload, a byte a pixel; its length must be a positive multiple of width."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    height = min(rows, len(pixels))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey_palette().tobytes()]
    for k in range(0, len(pixels), height):
        part, odd = pixels[k : k + height], k // height % 2
        disposal = 1 + k // height % 3
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | 1, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part), 0xC7 if odd else 0))
        if odd:
            out.append(warm_palette().tobytes())
            part = part[interlaced(len(part))]
        out.append(b"\x08" + sub_blocks(lzw_encode(part.tobytes())))
    return b"".join(out) + b"\x3b"


def bit_codes(bits: np.ndarray, start: int, count: int, width: int) -> np.ndarray:
    """count codes of width bits from bit start, low bits first."""
    return bits[start : start + count * width].reshape(count, width) @ (1 << np.arange(width))


def lzw_decode(data: bytes, least: int, size: int) -> np.ndarray:
    """The first size bytes that an LZW stream of minimum code size least stands for; a short stream gives fewer.

    Between clear codes the width of each code depends on its number only; so a stretch is read at once."""
    clear, out, have, at = 1 << least, [], 0, 0
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    while have < size:
        codes, end = [], None
        low, width = clear + 2, least + 1
        while end is None and at + width <= len(bits):
            # codes are read with this width until the table is full for it
            room = (1 << width) - low + (1 if width == least + 1 else 0) if width < 12 else 1 << 20
            count = min(max(room, 1), (len(bits) - at) // width)
            part = bit_codes(bits, at, count, width)
            if not codes and part[0] == clear:
                at += width
                continue
            stop = np.flatnonzero((part == clear) | (part == clear + 1))
            if len(stop):
                end = int(part[stop[0]])
                codes.append(part[: stop[0]])
                at += (int(stop[0]) + 1) * width
            else:
                codes.append(part)
                at += count * width
                if width < 12:
                    low, width = 1 << width, width + 1
        got = expand(np.concatenate(codes) if codes else np.zeros(0, np.int64), clear, size - have)
        out.append(got)
        have += len(got)
        if end != clear:
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def expand(codes: np.ndarray, clear: int, size: int) -> np.ndarray:
    """The bytes of one stretch: entry clear + 2 + i is the output of code i and the byte after it."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    literal = codes < clear
    ref = np.where(literal, -1, codes - clear - 2)
    if (ref >= np.arange(n)).any():
        raise ValueError("an LZW code is not in the table yet")
    up, more = ref.copy(), np.where(literal, 0, 1)
    # the length of a code is 1 and the steps to its literal
    while (up >= 0).any():
        live = np.flatnonzero(up >= 0)
        to = up[live]
        more[live] += more[to]
        up[live] = up[to]
    length = more + 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    owner = np.repeat(np.arange(n), length)
    pos = np.arange(total)
    source = np.where(literal[owner], pos, start[ref[owner]] + pos - start[owner])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.where(literal, codes, 0)
    return value[owner[source]][:size].astype(np.uint8)


@dataclass
class Frame:
    """One image as stored: place, palette indices, delay, disposal and transparent index."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    clear: int | None


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Screen width and height and the frames of a GIF; a damaged file raises ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, frames, control = 13, [], (0, 0, None)

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
        return table

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    try:
        shared = palette(flags) if flags & 0x80 else grey_palette()
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                label = data[at + 1]
                at += 2
                body = blocks()
                if label == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", body)
                    control = (delay, packed >> 2 & 7, index if packed & 1 else None)
            elif kind == 0x2C:
                left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                own = palette(packed) if packed & 0x80 else shared
                least = data[at]
                at += 1
                pixels = lzw_decode(blocks(), least, w * h)
                if len(pixels) < w * h:
                    raise ValueError("an image has too few pixels")
                pixels = pixels.reshape(h, w)
                if packed & 0x40:
                    pixels = pixels[np.argsort(interlaced(h))]
                frames.append(Frame(left, top, pixels, own, *control))
                control = (0, 0, None)
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that ends early") from e
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """Each frame as shown (RGBA): transparent pixels keep the canvas; disposal applies before the next."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        saved = canvas.copy() if f.disposal == 3 else None
        h, w = f.indices.shape
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        part = f.indices[: area.shape[0], : area.shape[1]]
        full = np.full((256, 4), 255, np.uint8)
        full[: len(f.palette), :3] = f.palette
        shown = full[part]
        if f.clear is None:
            area[:] = shown
        else:
            solid = part != f.clear
            area[solid] = shown[solid]
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif saved is not None:
            canvas = saved


def frame_histograms(width: int, height: int, frames: list[Frame]) -> list[np.ndarray]:
    """Counts of each frame's visible colours, in LEVELS levels a channel; clear pixels don't count."""
    step = 256 // LEVELS
    if len(frames) == 1 and frames[0].left + frames[0].indices.shape[1] <= width and frames[0].top + frames[0].indices.shape[0] <= height:
        # nothing lies below a single image: its indices are counted, then given their cells
        f = frames[0]
        n = np.bincount(f.indices.ravel(), minlength=256)
        if f.clear is not None:
            n[f.clear] = 0
        full = np.full((256, 3), 255 // step, np.int64)
        full[: len(f.palette)] = f.palette // step
        return [np.bincount(full @ (LEVELS * LEVELS, LEVELS, 1), n, LEVELS**3).astype(np.int64)]
    out = []
    for shown in composed(width, height, frames):
        seen = shown[shown[..., 3] > 0][:, :3] // step
        out.append(np.bincount(seen[:, 0].astype(np.int64) * (LEVELS * LEVELS) + seen[:, 1] * LEVELS + seen[:, 2], minlength=LEVELS**3))
    return out


FRAME = "array<struct<start_cs:long,delay_cs:int,width:int,height:int,histogram:array<long>>>"


def gif_columns(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, pixels, frames, error) of each row's GIF bytes.

    pixels: the palette indices of all frames, in order; frames: start and length of show in hundredths of a
    second, stored width and height, and the colour histogram as shown. Null or damaged media give null pixels,
    no frames and an error text; an extra or clashing column is ignored; rows repeat as they are."""
    hist = pa.list_(pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels, frames, errors = [], [], []
            for data in b.column(1):
                try:
                    data = data.as_py()
                    if data is None:
                        raise ValueError("no media")
                    w, h, got = read_gif(data)
                    shown, at = [], 0
                    for f, x in zip(got, frame_histograms(w, h, got), strict=True):
                        shown.append({"start_cs": at, "delay_cs": f.delay, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": x.tolist()})
                        at += f.delay
                    pixels.append(b"".join(f.indices.tobytes() for f in got))
                    frames.append(shown)
                    errors.append(None)
                except ValueError as e:
                    pixels.append(None)
                    frames.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pixels, pa.binary()), pa.array(frames, hist), pa.array(errors, pa.string())], ["key", "pixels", "frames", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media")).mapInArrow(decode, f"key {kind}, pixels binary, frames {FRAME}, error string").withColumnRenamed("key", key)


def store_gif(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, media) of each row: its text as UTF-8, padded with zeros to a positive multiple of width, as a GIF.

    Null text is empty. Rows repeat as they are; extra columns are ignored; an empty table gives no rows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, media = [], []
            for data in b.column(1):
                data = data.as_py() or b""
                size.append(len(data))
                media.append(encode_gif(data + bytes(-len(data) % width or (0 if data else width)), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("data")).mapInArrow(encode, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def gif_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """Digests of what store_gif writes to the shared folder and gif_columns reads back from there.

    Per row: key, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of the pixels read back, media_bytes,
    media_sha256, feature (frames, screen and pixels by colour cell over all frames as shown), frames, error."""
    stored = cut(store_gif(df, key, text), "media")
    of = F.struct(F.col(key).alias("id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    back = gif_columns(stored.select(of.alias("of"), "media"), "of", "media")
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), LEVELS**3), lambda acc, f: F.zip_with(acc, f["histogram"], lambda x, y: x + y))
    cells = F.filter(F.transform(total, lambda n, i: F.when(n > 0, F.concat_ws(":", i, n))), lambda x: x.isNotNull())
    first = F.get("frames", F.lit(0))
    feature = F.concat(F.concat_ws("x", F.size("frames"), first["width"], first["height"]), F.lit(";"), F.array_join(cells, ","))
    return back.select(
        F.col("of.id").alias(key), "of.n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"), "of.media_bytes", "of.media_sha256", feature.alias("feature"), "frames", "error",
    )
