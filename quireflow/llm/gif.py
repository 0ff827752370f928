"""GIF media columns: store byte planes as GIF files and decode GIF files to timed frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import slices

#: Stored payloads come in tiles of 24 x 24 pixels; a frame has up to MOST_TILES of them, one below another, and stands for 100 ms.
SIDE = 24
FRAME = SIDE * SIDE
MOST_TILES = 16
DELAY_CS = 10
#: Bins of a frame's colour histogram: two levels of red, green and blue.
BINS = 8


def _widths(code_bits: int, deferred: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit width and bit offset of the k-th code after a clear code; the table grows by one for every code but the first."""
    size = (1 << code_bits) + 2 + np.arange(4098 - (1 << code_bits)) - deferred
    width = np.clip(np.ceil(np.log2(np.maximum(size + 1, 2))).astype(np.int64), code_bits + 1, 12)
    return width, np.r_[0, np.cumsum(width)]


_READ = {bits: _widths(bits, 1) for bits in range(2, 9)}


#: Widths of the codes of an 8-bit stream, the leading clear code first.
_WRITE = np.r_[9, _READ[8][0]]
#: For reading: first byte, shift and mask of the k-th code after a clear code, by the bits that the clear code leaves in its last byte.
_PLACES = {bits: [((offset[:-1] + k) >> 3, (offset[:-1] + k) & 7, (1 << width) - 1) for k in range(8)] for bits, (width, offset) in _READ.items()}
_ROOTS = {bits: [bytes([i]) for i in range(1 << bits)] + [b"", b""] for bits in _READ}


def lzw_codes(pixels: bytes) -> list[list[int]]:
    """GIF's LZW of 8-bit samples as runs of codes, each ended by a clear code (256) or the end code (257)."""
    runs, codes, table, following = [], [], {}, 258
    known, put = table.setdefault, codes.append
    prefix = pixels[0] if pixels else -1
    for c in pixels[1:]:
        found = known(prefix << 8 | c, following)  # a new string takes the next code
        if found != following:
            prefix = found
            continue
        put(prefix)
        prefix = c
        following += 1
        if following == 4096:
            put(256)
            runs.append(codes)
            codes, table, following = [], {}, 258
            known, put = table.setdefault, codes.append
    return [*runs, [*codes, *([prefix] if prefix >= 0 else []), 257]]


def pack_codes(frames: list[list[list[int]]]) -> list[bytes]:
    """Code streams of many frames at once, each with a clear code ahead; codes are written low bits first."""
    value = np.array([c for runs in frames for k, run in enumerate(runs) for c in ([256, *run] if k == 0 else run)], dtype=np.int64)
    lengths = np.array([len(run) + (k == 0) for runs in frames for k, run in enumerate(runs)])
    first = np.array([k == 0 for runs in frames for k in range(len(runs))])
    starts = np.cumsum(lengths) - lengths
    rank = np.arange(len(value)) - np.repeat(starts - ~first, lengths)  # runs after the first have no clear code ahead
    size = _WRITE[rank]
    before = np.cumsum(size) - size
    heads = starts[first]
    bits = np.diff(np.r_[before[heads], before[-1] + size[-1]])
    room = -(-bits // 8)
    at = np.cumsum(room) - room
    frame_codes = np.diff(np.r_[heads, len(value)])
    place = before + np.repeat(at * 8 - before[heads], frame_codes)
    shifted, cell = value << (place & 7), place >> 3
    out = np.zeros(int(room.sum()) + 3, dtype=np.uint8)
    for k in range(3):
        np.add.at(out, cell + k, (shifted >> (8 * k) & 255).astype(np.uint8))
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip(at.tolist(), room.tolist(), strict=True)]


def lzw_decode(data: bytes, code_bits: int, limit: int) -> bytes:
    """Up to `limit` samples of a GIF code stream; what follows an end code or a lacking byte is not read."""
    width, offset = _READ[code_bits]
    clear, stop = 1 << code_bits, (1 << code_bits) + 1
    roots = _ROOTS[code_bits]
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    out: list[bytes] = []
    have, at, total = 0, 0, len(data) * 8
    if total > code_bits and int.from_bytes(data[:2], "little") & (1 << code_bits + 1) - 1 == clear:
        at = code_bits + 1
    table, last, full = list(roots), b"", False
    while have < limit:
        # between clear codes the widths follow from the count, so a stretch of codes is cut out at once; with a full table they stay at 12 bits
        most = min((total - at) // 12, 4096) if full else min(int(offset.searchsorted(total - at, side="right")) - 1, len(width))
        n = min(most, limit - have + 3)
        if n <= 0:
            break
        if full:
            place = (at & 7) + 12 * np.arange(n)
            byte, shift, mask = place >> 3, place & 7, 4095
        else:
            byte, shift, mask = (x[:n] for x in _PLACES[code_bits][at & 7])
        byte = byte + (at >> 3)
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> shift & mask
        used, again, before = 0, False, len(out)
        add, put, todo = table.append, out.append, codes.tolist()
        for used, code in enumerate(todo, 1):
            try:
                entry = table[code]
            except IndexError:  # the entry that this code itself completes
                entry = last + last[:1]
            if not entry:  # roots of the clear and stop codes are empty
                again = code == clear
                break
            if last and not full:
                add(last + entry[:1])
            put(entry)
            last = entry
        have = limit if used and not again and code == stop else have + sum(map(len, out[before:]))
        at += 12 * used if full else int(offset[used])
        if again:
            table, last, full = list(roots), b"", False
        elif full or n == len(width):
            full = True
        else:
            break
    return b"".join(out)[:limit]


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of at most 255 bytes with an empty one at the end."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _packed(frames: Iterator[bytes]) -> Iterator[bytes]:
    """Code streams of frames, packed together for about GROUP bytes of them at a time."""
    group, size = [], 0
    for f in frames:
        group.append(lzw_codes(f))
        size += len(f)
        if size >= GROUP:
            yield from pack_codes(group)
            group, size = [], 0
    yield from pack_codes(group) if group else ()


_PALETTE = bytes(v for i in range(256) for v in (i, i, i))


#: Bytes of frames that are encoded together.
GROUP = 1 << 20
#: Pixels of a screen that are decoded, as a header can claim any size; they take four bytes each. Frames are shown one after another, so their number isn't bounded.
MOST_SCREEN = 1 << 26


def tiles_of_frame(tiles: int) -> int:
    """Tiles in each frame: the largest number up to MOST_TILES that divides the payload's, so that all frames fill the screen."""
    return next(k for k in range(min(tiles, MOST_TILES), 0, -1) if tiles % k == 0)


def _frames_of(text: bytes | memoryview) -> tuple[int, int]:
    """Bytes of a frame, and number of frames, of a text's payload."""
    tiles = max(1, -(-len(text) // FRAME))
    step = tiles_of_frame(tiles) * FRAME
    return step, tiles * FRAME // step


def gif_parts(texts: list[bytes | memoryview]) -> Iterator[bytes | None]:
    """For each text (padded with 255s to a positive multiple of 576) the parts of an animated GIF, 24 pixels wide, that holds it as grey frames without loss; None ends a file."""

    def frames() -> Iterator[bytes]:
        for t in texts:
            step, count = _frames_of(t)
            yield from (bytes(t[i * step : (i + 1) * step]).ljust(step, b"\xff") for i in range(count))

    streams = _packed(frames())
    for t in texts:
        step, count = _frames_of(t)
        screen = SIDE.to_bytes(2, "little") + (step // SIDE).to_bytes(2, "little")
        head = b"\x21\xf9\x04\x04" + DELAY_CS.to_bytes(2, "little") + b"\0\0\x2c\0\0\0\0" + screen + b"\0\x08"
        yield b"GIF89a" + screen + b"\xf7\0\0" + _PALETTE
        for _ in range(count):
            yield head + _blocks(next(streams))
        yield b"\x3b"
        yield None


def write_gifs(texts: list[bytes]) -> list[bytes]:
    out, parts = [], []
    for p in gif_parts(texts):
        if p is None:
            out.append(b"".join(parts))
            parts = []
        else:
            parts.append(p)
    return out


#: What of a frame is shown: a table over the palette's colours, and the value of a blank pixel.
View = tuple[Callable[[np.ndarray], np.ndarray], int]
RGBA: View = (lambda palette: np.c_[palette, np.full(len(palette), 255, np.uint8)].copy().view(np.uint32).ravel(), 0)
LUMA: View = (lambda palette: (palette.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8), 0)
BIN: View = (lambda palette: (palette >> 7) @ np.array([4, 2, 1], np.uint8), BINS)


def show_gif(data: bytes | memoryview, most_screen: int = MOST_SCREEN, views: tuple[View, ...] = (RGBA,)) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The frames of a file as shown, one after another: delay in ms and a canvas (height, width) for each view, which the next frame changes.

    Local before global palettes; interlaced rows are put in order; a transparent index leaves
    the canvas as it is; disposal 2 clears a frame's area, 3 restores what was there before. Other
    data, and a screen of over most_screen pixels, raise.
    """
    if len(data) < 13 or bytes(data[:6]) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at, shared = 13, None
    if data[10] & 0x80:
        n = 2 << (data[10] & 7)
        shared, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    if width * height > most_screen:
        raise ValueError(f"over {most_screen} pixels")
    known = None
    blank = np.zeros((1, 3), np.uint8)
    canvases = [np.full((height, width), none, table(blank).dtype) for table, none in views]
    delay, disposal, clear = 0, 0, -1

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = int.from_bytes(body[1:3], "little") * 10, body[0] >> 2 & 7
                clear = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]}")
        x, y, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        flags, at, palette = data[at + 9], at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        if palette is None or x + w > width or y + h > height or not 2 <= data[at] <= 8:
            raise ValueError("frame without palette, out of the screen or with a bad code size")
        code_bits = data[at]
        body, at = sub_blocks(at + 1)
        pixels = lzw_decode(body, code_bits, w * h)
        if len(pixels) < w * h:
            raise ValueError("code stream ends early")
        index = np.frombuffer(pixels, np.uint8).reshape(h, w)
        if flags & 0x40:
            rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            ordered = np.empty_like(index)
            ordered[rows] = index
            index = ordered
        if palette is not known:
            known, tables = palette, [table(palette) for table, _ in views]
        uncut, index = index, index if len(palette) == 256 else np.minimum(index, len(palette) - 1)
        areas = [c[y : y + h, x : x + w] for c in canvases]
        before = [a.copy() for a in areas] if disposal == 3 else None
        for area, table in zip(areas, tables, strict=True):
            if clear < 0:
                area[...] = table[index]
            else:
                drawn = uncut != clear
                area[drawn] = table[index[drawn]]
        yield delay, canvases
        for k, (area, (_, none)) in enumerate(zip(areas, views, strict=True)):
            if disposal == 2:
                area[...] = none
            elif before is not None:
                area[...] = before[k]
        delay, disposal, clear = 0, 0, -1


def read_gif(data: bytes | memoryview) -> tuple[int, int, list[tuple[int, np.ndarray]]]:
    """Width, height and all frames as shown: delay in ms and the canvas (height, width, RGBA)."""
    width, height = (int.from_bytes(data[k : k + 2], "little") for k in (6, 8))
    return width, height, [(delay, canvas.copy().view(np.uint8).reshape(height, width, 4)) for delay, (canvas,) in show_gif(data)]


def _buffers(batch: pa.RecordBatch, column: str) -> list[memoryview | None]:
    """The column's bytes without a copy."""
    return [memoryview(v.as_buffer()).cast("B") if v.is_valid else None for v in batch.column(column).cast(pa.large_binary())]


def _binary(out: pa.BufferOutputStream, ends: list[int], valid: list[bool]) -> pa.Array:
    """What was written as a column of bytes, without a copy."""
    bits = np.packbits(np.array(valid, bool), bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(valid), [pa.py_buffer(bits), pa.py_buffer(np.array([0, *ends], np.int32)), out.getvalue()])


def store_gifs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text in UTF-8) and media, a GIF that holds these bytes and 255s up to a positive multiple of 576.

    Null and empty texts give one frame of 255s; equal texts give equal files; rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            own = [b"" if t is None else t for t in _buffers(batch, "__text")]
            out, ends = pa.BufferOutputStream(), []
            for part in gif_parts(own):
                if part is None:
                    ends.append(out.tell())
                else:
                    out.write(part)
            cols = [batch.column("__key"), pa.array([len(t) for t in own], pa.int64()), _binary(out, ends, [True] * len(own))]
            yield pa.RecordBatch.from_arrays(cols, names=["__key", "n_bytes", "media"])

    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return src.mapInArrow(run, f"__key {src.schema['__key'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("__key", key)


def read_gifs(media: DataFrame, column: str = "media", most_screen: int = MOST_SCREEN) -> DataFrame:
    """Decode a column of GIF files; all columns of media are kept.

    Adds width, height, frames (array of start_ms, delay_ms and hist, the counts of 8 colour bins,
    transparent pixels not counted), luma (all frames' brightness planes, one after another) and
    error. Frames are decoded one after another, so beside the file and its luma only one canvas is
    in memory, however many frames there are. Null media and files that can't be decoded give
    nulls, the latter with an error; so does a screen of over most_screen pixels, as a header can
    claim any size. Columns of media with these names are replaced.
    """
    added = ["width", "height", "frames", "luma", "error"]
    media = media.drop(*added)
    frame = pa.list_(pa.struct([("start_ms", pa.int32()), ("delay_ms", pa.int32()), ("hist", pa.list_(pa.int32()))]))

    def one(data: memoryview | None, luma: pa.BufferOutputStream) -> tuple:
        if data is None:
            return None, None, None, False, None
        frames, start, planes = [], 0, []
        try:
            for delay, (plane, bins) in show_gif(bytes(data) if len(data) < GROUP else data, most_screen, (LUMA, BIN)):
                planes.append(plane.tobytes())
                frames.append({"start_ms": start, "delay_ms": delay, "hist": np.bincount(bins.ravel(), minlength=BINS + 1)[:BINS].tolist()})
                start += delay
        except (ValueError, IndexError) as e:
            return None, None, None, False, str(e)[:200] or "cut short"
        for plane in planes:
            luma.write(plane)
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), frames, True, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1 << 20):
            luma, ends, rows = pa.BufferOutputStream(), [], []
            for data in _buffers(batch, column):
                rows.append(one(data, luma))
                ends.append(luma.tell())
            width, height, frames, valid, error = ([r[k] for r in rows] for k in range(5))
            cols = [pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(frames, frame), _binary(luma, ends, valid), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *added])

    ddl = f"{media._jdf.schema().toDDL()}, width int, height int, frames array<struct<start_ms:int,delay_ms:int,hist:array<int>>>, luma binary, error string"
    return media.mapInArrow(run, ddl)
