"""GIF89a: an LZW codec, a container reader and writer, and a renderer with palettes, disposal and transparency.

The codec handles many images of one size in step: each step takes one sample (encoding) or one code (decoding) of every image by numpy operations, with a table of strings for each.
The reader takes any valid file; images of all files that it is given are decoded together.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: most codes of a table, most bytes of a block.
CODES, BLOCK = 4096, 255
GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
#: Images that are handled in step.
STEP = 1024


@dataclass
class Frame:
    """One image of a file. delay is in hundredths of a second; disposal 0-3 as the format has them."""

    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


def _schedule(min_code: int, codes: int) -> tuple[list[int], list[int]]:
    """(widths, bit offsets) of so many codes of a stream. Each code but the first after a clear code adds a string, so that widths and clear codes stand at the same places in every stream."""
    widths, offsets, at = [], [], 0
    size, width = (1 << min_code) + 2, min_code + 1
    fresh = True  # a clear code comes
    for _ in range(codes):
        widths.append(width)
        offsets.append(at)
        at += width
        if fresh:
            size, width, fresh = (1 << min_code) + 2, min_code + 1, False
        elif size < CODES:
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        else:
            fresh = True
    return widths, offsets


def lzw_encode(samples: np.ndarray, min_code: int = 8) -> list[bytes]:
    """The LZW code streams of images (one in each row of samples, all below 1 << min_code)."""
    return [x for s in range(0, len(samples), STEP) for x in _encode(np.ascontiguousarray(samples[s : s + STEP]), min_code)]


def _encode(samples: np.ndarray, min_code: int) -> list[bytes]:
    count, n = samples.shape
    clear, end = 1 << min_code, (1 << min_code) + 1
    room = 1024
    while room < 3 * min(n, CODES):
        room *= 2
    # strings by (code of all but the last sample, last sample), in open tables; the hash is spread over a row
    keys, strings = np.full(count * room, -1, dtype=np.int32), np.empty(count * room, dtype=np.int16)
    rows = np.arange(count)
    row = rows * room
    columns = samples.T.astype(np.int32)
    prefix, size = columns[0].copy(), end + 1
    sizes, used = np.full(count, size), np.ones(count, dtype=np.int64)
    codes = np.zeros((count, n + n // 3000 + 4), dtype=np.uint16)
    codes[:, 0] = clear
    for t in range(1, n):
        s = columns[t]
        key = prefix << 8 | s
        slot = row + ((key * np.int32(40503) >> 5) & (room - 1))
        found = keys[slot]
        other = np.flatnonzero((found != key) & (found != -1))
        while len(other):
            slot[other] = row[other] + ((slot[other] + 1) & (room - 1))
            found[other] = keys[slot[other]]
            other = other[(found[other] != key[other]) & (found[other] != -1)]
        new = np.flatnonzero(found != key)
        following = strings[slot].astype(np.int32)
        following[new] = s[new]
        codes[new, used[new]] = prefix[new]
        used[new] += 1
        full = new[sizes[new] == CODES]
        if len(full):
            codes[full, used[full]] = clear
            used[full] += 1
            keys.reshape(count, room)[full] = -1
            sizes[full] = end + 1
            new = new[~np.isin(new, full)]
        keys[slot[new]] = key[new]
        strings[slot[new]] = sizes[new]
        sizes[new] += 1
        prefix = following
    codes[rows, used] = prefix
    codes[rows, used + 1] = end
    used += 2
    widths, offsets = _schedule(min_code, int(used.max()))
    lengths = (np.array(offsets)[used - 1] + np.array(widths)[used - 1] + 7) // 8
    out = np.zeros((count, offsets[-1] // 8 + 4), dtype=np.uint8)
    for j, at in enumerate(offsets):
        bits = codes[:, j].astype(np.uint32) << np.uint32(at & 7)
        k = at >> 3
        out[:, k] |= (bits & 255).astype(np.uint8)
        out[:, k + 1] |= (bits >> np.uint32(8) & 255).astype(np.uint8)
        out[:, k + 2] |= (bits >> np.uint32(16)).astype(np.uint8)
    return [out[i, :m].tobytes() for i, m in enumerate(lengths.tolist())]


def lzw_decode(streams: list[bytes], min_code: int, size: int) -> np.ndarray:
    """Samples of images of one size, from any valid streams: each stops at its end code, at `size` samples or where it ends (what lacks is 0)."""
    parts = [_decode(streams[s : s + STEP], min_code, size) for s in range(0, len(streams), STEP)]
    return np.concatenate(parts) if parts else np.zeros((0, size), dtype=np.uint8)


def _decode(streams: list[bytes], min_code: int, n: int) -> np.ndarray:
    count = len(streams)
    lengths = np.array([len(s) for s in streams])
    wide = int(lengths.max(initial=0)) + 3
    data = np.zeros((count, wide), dtype=np.uint8)
    for i, s in enumerate(streams):
        data[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
    # three bytes at each place, as one number
    data = data.reshape(-1).astype(np.int32)
    data[:-2] |= data[1:-1] << 8 | data[2:] << 16
    out = np.zeros((count, n), dtype=np.uint8)
    flat = out.reshape(-1)
    clear, end = 1 << min_code, (1 << min_code) + 1
    # a string is a range of the samples that are out already; there are no more than samples
    room = min(CODES, end + 2 + n)
    begin, length = np.zeros(count * room, dtype=np.int32), np.zeros(count * room, dtype=np.int32)
    f = np.arange(count) if n else np.zeros(0, dtype=np.int64)
    bit, width, size = (np.full(count, v) for v in (0, min_code + 1, end + 1))
    at, before, last = (np.zeros(count, dtype=np.int64) for _ in range(3))  # samples so far; start and length of the string before
    while len(f):
        f = f[bit[f] + width[f] <= 8 * lengths[f]]
        b, w = bit[f], width[f]
        code = (data[f * wide + (b >> 3)] >> (b & 7)) & ((1 << w) - 1)
        bit[f] = b + w
        special = (code == clear) | (code == end)
        if special.any():
            again = f[code == clear]
            width[again], size[again], last[again] = min_code + 1, end + 1, 0
            go_on = code != end
            done = ~special
            stay, f, code = f[go_on], f[done], code[done]
        else:
            stay = f
        if len(f):
            pos, had, table = at[f], last[f], size[f]
            literal, known = code < clear, code < table
            if not (known | ((code == table) & (had > 0))).all():
                raise ValueError("a code that is not in the table")
            entry = f * room + np.minimum(code, room - 1)
            source = np.where(known, begin[entry], before[f])
            whole = np.where(literal, 1, np.where(known, length[entry], had + 1))
            size_now = np.minimum(whole, n - pos)
            one = np.flatnonzero(literal)
            place = f * n + pos
            flat[place[one]] = code[one]
            many = np.flatnonzero(~literal)
            if len(many):
                m = size_now[many]
                ends = np.cumsum(m)
                to = np.arange(int(ends[-1])) + np.repeat(place[many] - (ends - m), m)
                flat[to] = flat[to - np.repeat(pos[many] - source[many], m)]
                # a string that is just being made ends with its own first sample
                own = many[(~known & (whole == size_now))[many]]
                flat[place[own] + whole[own] - 1] = flat[place[own]]
            add = np.flatnonzero((had > 0) & (table < CODES))
            g = f[add]
            entry = g * room + table[add]
            begin[entry], length[entry] = before[g], had[add] + 1
            size[g] += 1
            wider = g[(size[g] == 1 << width[g]) & (width[g] < 12)]
            width[wider] += 1
            before[f], last[f] = pos, whole
            at[f] = pos + size_now
        f = stay[at[stay] < n]
    return out


def _size_bits(colours: int) -> int:
    """The format's code for a palette of 2, 4, ... 256 colours."""
    return (colours - 1).bit_length() - 1


def write(gif: Gif) -> bytes:
    """A whole file."""
    return write_many([gif])[0]


def write_many(gifs: list[Gif]) -> list[bytes]:
    """Files; images of equal size and palette depth are encoded together."""
    jobs: dict[tuple, list[Frame]] = {}
    for gif in gifs:
        for f in gif.frames:
            jobs.setdefault((_depth(gif, f), f.indices.size), []).append(f)
    streams: dict[int, bytes] = {}
    for (depth, _), frames in jobs.items():
        streams |= zip(map(id, frames), lzw_encode(np.stack([f.indices.reshape(-1) for f in frames]).astype(np.uint8), depth), strict=True)
    out = []
    for gif in gifs:
        flags = 0x70 if gif.palette is None else 0xF0 | _size_bits(len(gif.palette))
        parts = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, flags, gif.background, 0)]
        if gif.palette is not None:
            parts.append(gif.palette.astype(np.uint8).tobytes())
        for f in gif.frames:
            h, w = f.indices.shape
            parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0) + b"\x00")
            parts.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0 if f.palette is None else 0x80 | _size_bits(len(f.palette))))
            if f.palette is not None:
                parts.append(f.palette.astype(np.uint8).tobytes())
            data = streams[id(f)]
            parts.append(bytes([_depth(gif, f)]))
            parts += [bytes([min(BLOCK, len(data) - s)]) + data[s : s + BLOCK] for s in range(0, len(data), BLOCK)]
            parts.append(b"\x00")
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def _depth(gif: Gif, f: Frame) -> int:
    palette = f.palette if f.palette is not None else gif.palette if gif.palette is not None else GRAY
    return max(2, (len(palette) - 1).bit_length())


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read(data: bytes) -> Gif:
    """Any GIF87a or GIF89a file: global and local palettes, control and other extensions, interlaced rows."""
    return read_many([data])[0]


def read_many(files: list[bytes]) -> list[Gif]:
    """Files; their images are decoded together."""
    gifs, jobs = [], {}
    for data in files:
        gifs.append(_container(data, jobs))
    for (min_code, size), found in jobs.items():
        flat = lzw_decode([stream for _, _, stream in found], min_code, size)
        for image, (frame, interlaced, _) in zip(flat, found, strict=True):
            h, w = frame.indices.shape
            image = image.reshape(h, w)
            if interlaced:
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                image, rows = np.empty_like(image), image
                image[order] = rows
            frame.indices = image
    return gifs


def _container(data: bytes, jobs: dict) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
    gif, control = Gif(width, height, palette, background), (0, 0, None)
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                control = (bits >> 2 & 7, delay, index if bits & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, own = at + 10, None
            if flags & 0x80:
                n = 2 << (flags & 7)
                own = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
                at += 3 * n
            min_code = data[at]
            stream, at = _blocks(data, at + 1)
            frame = Frame(np.zeros((h, w), dtype=np.uint8), left, top, control[1], control[0], control[2], own)
            jobs.setdefault((min_code, w * h), []).append((frame, bool(flags & 0x40), stream))
            gif.frames.append(frame)
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {kind:#x}")
    return gif


def render(gif: Gif) -> list[tuple[int, np.ndarray]]:
    """(delay, canvas in RGBA) as shown for each frame. Disposal: 0 and 1 leave the frame, 2 clears its area, 3 brings back what was there before."""
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    shown = []
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.indices.shape
        h, w = min(h, gif.height - f.top), min(w, gif.width - f.left)
        idx = f.indices[:h, :w]
        palette = f.palette if f.palette is not None else gif.palette if gif.palette is not None else GRAY
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        colours = palette[idx if len(palette) == 256 else np.minimum(idx, len(palette) - 1)]
        if f.transparent is None:
            area[:, :, :3] = colours
            area[:, :, 3] = 255
        else:
            solid = idx != f.transparent
            np.copyto(area[:, :, :3], colours, where=solid[:, :, None])
            area[:, :, 3][solid] = 255
        shown.append((f.delay, canvas.copy()))
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before
    return shown
