import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tallgrass.llm import gif, op6_media
from tallgrass.llm.common import table


def plain_encode(samples, min_code=8):
    """LZW one sample after another, with a dictionary of strings."""
    clear, end = 1 << min_code, (1 << min_code) + 1
    out, strings, width, word = [(clear, min_code + 1)], {bytes([i]): i for i in range(clear)}, min_code + 1, b""
    size = end + 1
    for v in samples:
        longer = word + bytes([v])
        if longer in strings:
            word = longer
            continue
        out.append((strings[word], width))
        if size < 4096:
            strings[longer] = size
            width += size == 1 << width and width < 12
            size += 1
        else:
            out.append((clear, width))
            strings, width, size = {bytes([i]): i for i in range(clear)}, min_code + 1, end + 1
        word = bytes([v])
    out.append((strings[word], width))
    width += size == 1 << width and width < 12
    out.append((end, width))
    bits = "".join(format(c, f"0{w}b")[::-1] for c, w in out)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def plain_decode(stream, min_code, n):
    clear, end = 1 << min_code, (1 << min_code) + 1
    bits = "".join(format(b, "08b")[::-1] for b in stream)
    strings, width, before, out, at = [bytes([i]) for i in range(clear)] + [b"", b""], min_code + 1, b"", b"", 0
    while at + width <= len(bits) and len(out) < n:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            strings, width, before = strings[: end + 1], min_code + 1, b""
            continue
        if code == end:
            break
        entry = strings[code] if code < len(strings) else before + before[:1]
        out += entry
        if before and len(strings) < 4096:
            strings.append(before + entry[:1])
            width += len(strings) == 1 << width and width < 12
        before = entry
    return out[:n]


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 576, 5000, 30000])
@pytest.mark.parametrize("min_code", [2, 4, 8])
def test_lzw_against_one_sample_at_a_time(n, min_code):
    rng = np.random.default_rng(n * min_code)
    images = np.stack([rng.integers(0, min(spread, 1 << min_code), n) for spread in (1, 2, 3, 16, 256)] + [np.arange(n) % (1 << min_code), np.zeros(n, dtype=int)]).astype(np.uint8)
    streams = gif.lzw_encode(images, min_code)
    assert streams == [plain_encode(x.tolist(), min_code) for x in images]
    assert [plain_decode(s, min_code, n) for s in streams[:3]] == [x.tobytes() for x in images[:3]]
    assert (gif.lzw_decode(streams, min_code, n) == images).all()


def test_streams_of_other_writers():
    def pack(codes):
        bits = "".join(format(c, f"0{w}b")[::-1] for c, w in codes)
        return bytes(int(bits[i : i + 8][::-1].zfill(8), 2) for i in range(0, len(bits), 8))

    early = pack([(256, 9), (7, 9), (258, 9), (256, 9), (3, 9), (4, 9), (258, 9), (257, 9)])  # a clear code early, a string of itself
    cut = pack([(256, 9), (9, 9)])  # no end code
    no_clear = pack([(1, 9), (2, 9), (258, 9), (257, 9)])
    got = gif.lzw_decode([early, cut, no_clear, b""], 8, 8)
    assert got.tolist() == [[7, 7, 7, 3, 4, 3, 4, 0], [9] + [0] * 7, [1, 2, 1, 2, 0, 0, 0, 0], [0] * 8]
    with pytest.raises(ValueError):
        gif.lzw_decode([pack([(256, 9), (300, 9)])], 8, 8)
    assert gif.lzw_decode([], 8, 8).shape == (0, 8)


def test_disposal_and_transparency():
    palette = np.zeros((256, 3), dtype=np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 255, 0)
    full, dot = np.ones((4, 4), dtype=np.uint8), np.full((2, 2), 2, dtype=np.uint8)
    holes = np.array([[2, 0], [0, 2]], dtype=np.uint8)
    own = np.array([[0, 0, 0], [0, 0, 255]], dtype=np.uint8)[[0, 1, 1, 1]]
    g = gif.Gif(4, 4, palette, frames=[gif.Frame(full, delay=5), gif.Frame(dot, 1, 1, 7, 3), gif.Frame(holes, 0, 0, 9, 2, 0), gif.Frame(dot, 2, 2, 1, 0), gif.Frame(full, 0, 0, 2, 0, None, own)])
    shown = gif.render(gif.read(gif.write(g)))
    assert [d for d, _ in shown] == [5, 7, 9, 1, 2]
    assert (shown[0][1][:, :, 0] == 255).all()
    assert shown[1][1][1, 1].tolist() == [0, 255, 0, 255]
    assert shown[2][1][1, 1].tolist() == [0, 255, 0, 255]  # its own dot: the frame before was taken back
    assert shown[2][1][0, 1].tolist() == [255, 0, 0, 255]  # seen through a hole
    assert shown[3][1][0, 0].tolist() == [0, 0, 0, 0]  # cleared
    assert shown[3][1][3, 3].tolist() == [0, 255, 0, 255]
    assert shown[4][1][3, 3].tolist() == [0, 0, 255, 255]  # a palette of its own


def plain_row(doc_id, raw):
    """All columns by another reader: container, codes and drawing one byte after another."""
    media = op6_media.to_media(raw)
    want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    at, canvas, payload, delays, kinds, control = 13 + 768, [0] * 576, b"", 0, set(), None
    while media[at] != 0x3B:
        if media[at] == 0x21:
            control = struct.unpack_from("<BHB", media, at + 3)
            at += 8
            continue
        local = media[at + 9] & 0x80
        at += 10
        grays = list(range(256))
        if local:
            grays, at = [media[at + 3 * k] for k in range(16)], at + 48
        depth, stream, at = media[at], b"", at + 1
        while media[at]:
            stream, at = stream + media[at + 1 : at + 1 + media[at]], at + 1 + media[at]
        at += 1
        for k, v in enumerate(plain_decode(stream, depth, 576)):
            if not (control[0] & 1 and v == control[2]):
                canvas[k] = grays[v]
        shown = bytes(canvas)
        payload, delays = payload + shown, delays + control[1]
        kinds.add(tuple(sum(v >> 5 == k for v in shown) for k in range(8)))
        if control[0] >> 2 == 2:
            canvas = [0] * 576
    assert payload == want
    feature = [sum(v >> 5 == k for v in want) for k in range(8)] + [len(want) // 576, delays, len(kinds)]
    return (doc_id, len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]), len(media), hashlib.sha256(media).hexdigest(), ":".join(map(str, feature)))


def texts():
    rng = random.Random(3)
    line = "the same words again and again in every frame of it\n"
    return ["", "a", "é" * 288, "x" * 576, "x" * 577, "ab" * 3000, line * 60, line * 30 + "other" * 100 + line * 30, "".join(chr(rng.randrange(1, 500)) for _ in range(4000)), "\n" * 2000]


def test_query_against_brute_force(spark, tmp_path):
    rows = [*enumerate(texts()), (50, None), (50, None), (None, "z")]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_media.op6_media(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(i, (t or "").encode())) for i, t in rows)
    parts = op6_media.read_media(op6_media.store_media(docs)).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))
    assert op6_media.media_digests(docs.limit(0)).count() == 0


def test_every_frame_goes_through_the_codec_and_the_renderer(monkeypatch):
    seen = {"encoded": 0, "decoded": 0, "rendered": 0}
    encode, decode, render = gif.lzw_encode, gif.lzw_decode, gif.render
    monkeypatch.setattr(gif, "lzw_encode", lambda x, m=8: seen.update(encoded=seen["encoded"] + len(x)) or encode(x, m))
    monkeypatch.setattr(gif, "lzw_decode", lambda s, m, n: seen.update(decoded=seen["decoded"] + len(s)) or decode(s, m, n))
    monkeypatch.setattr(gif, "render", lambda g: seen.update(rendered=seen["rendered"] + len(g.frames)) or render(g))
    raw = [t.encode() for t in texts()]
    media = gif.write_many(op6_media.to_gifs(raw))
    op6_media.digests(list(range(len(raw))), list(map(len, raw)), media)
    frames = sum(max(1, -(-len(t) // 576)) for t in raw)
    assert set(seen.values()) == {frames}
    files = gif.read_many(media)
    every = [f for file in files for f in file.frames]
    assert any(f.transparent is not None for f in every) and any(f.palette is not None for f in every)
    assert {f.disposal for f in every} == {1, 2} and len({f.delay for f in every}) > 2


def test_frames_are_stored_with_histograms(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = op6_media.frames(op6_media.store_media(docs)).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.frame)):
        assert r.histogram == np.bincount(np.frombuffer(r.samples, dtype=np.uint8) >> 5, minlength=8).tolist()
        by_doc[r.doc_id] = by_doc.get(r.doc_id, b"") + r.samples
    for r in docs.collect():
        raw = (r.text or "").encode()
        assert by_doc[r.doc_id] == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
