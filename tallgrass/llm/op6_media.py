"""Media columns: documents stored as GIF files of timed frames, read back by the LZW decoder and the renderer, with colour histograms.

A text becomes its UTF-8 bytes, filled with bytes 255 up to a positive multiple of a frame's 24 x 24 samples; each 576 bytes are one frame as it is shown, over a gray palette:

- A frame that has SAME or more of its samples in common with the one before lets them shine through: they get a transparent index, some value that the frame doesn't need.
  The frame before then has disposal 1 (stays); otherwise 2 (its area is cleared).
- A frame of fewer than LOCAL different samples has a local palette of these grays, with shorter codes.
- A frame is shown for 4 hundredths of a second and one more for each line that ends in it.

Reading parses the file, decodes all code streams, draws the frames one after another by their palettes, disposal and transparency, and takes the gray of every pixel.

Rows are independent: no shuffle. Batches are taken in slices of 1 MB, whose frames are encoded and decoded in step.

Null or empty text: one frame of 255s, n_bytes 0. Null doc_id stays null. Repeated rows give repeated rows. An empty table gives an empty one. Very long texts are a slice of their own. Columns
besides the id and the text are not read, whatever their names. There is nothing that ties could change.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import gif
from tallgrass.llm.common import by_slices, table, utf8

SIDE = 24
FRAME = SIDE * SIDE
SAME, LOCAL = FRAME // 8, 16
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_gifs(texts: list[bytes | np.ndarray]) -> list[gif.Gif]:
    """A file for each text, not yet encoded."""
    counts = [max(1, -(-len(t) // FRAME)) for t in texts]
    total = sum(counts)
    flat = np.full(total * FRAME, 255, dtype=np.uint8)
    at, first = 0, []
    for t, n in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8) if isinstance(t, bytes) else t
        first.append(at // FRAME)
        at += n * FRAME
    shown = flat.reshape(total, FRAME)
    rows = np.arange(total)[:, None]
    follows = np.ones(total, dtype=bool)
    follows[first] = False
    same = np.zeros((total, FRAME), dtype=bool)
    same[1:] = shown[1:] == shown[:-1]
    same[(same.sum(axis=1) < SAME) | ~follows] = False
    # values that a frame has to show by itself
    has = np.zeros((total, 256), dtype=bool)
    has[np.broadcast_to(rows, shown.shape)[~same], shown[~same]] = True
    n_values, free = has.sum(axis=1), np.argmin(has, axis=1)
    through = same.any(axis=1) & (n_values < 256)
    local = n_values < LOCAL
    # with a local palette, an index is the rank of its value; the last index is free
    rank = np.cumsum(has, axis=1) - 1
    indices = np.where(local[:, None], rank[rows, shown], shown)
    holes = same & through[:, None]
    clear = np.where(local, LOCAL - 1, free)
    indices = np.where(holes, clear[:, None], indices).astype(np.uint8).reshape(total, SIDE, SIDE)
    lines = (shown == 10).sum(axis=1)
    out = []
    for start, n in zip(first, counts, strict=True):
        file = gif.Gif(SIDE, SIDE, gif.GRAY)
        for k in range(start, start + n):
            stays = k + 1 < start + n and through[k + 1]
            palette = None
            if local[k]:
                palette = np.zeros((LOCAL, 3), dtype=np.uint8)
                palette[: n_values[k]] = np.flatnonzero(has[k])[:, None]
            file.frames.append(gif.Frame(indices[k], 0, 0, int(4 + lines[k]), 1 if stays else 2, int(clear[k]) if through[k] else None, palette))
        out.append(file)
    return out


def to_media(raw: bytes | np.ndarray) -> bytes:
    """The file that holds these bytes."""
    return gif.write_many(to_gifs([raw]))[0]


def shown_samples(file: gif.Gif) -> np.ndarray:
    """The gray of every pixel of every frame as shown: a row for each frame."""
    return np.stack([canvas[:, :, 0].reshape(-1) for _, canvas in gif.render(file)])


def from_media(media: bytes) -> np.ndarray:
    """The stored samples, frame after frame, in one row."""
    return shown_samples(gif.read(media)).reshape(-1)


def histograms(samples: np.ndarray) -> np.ndarray:
    """For each frame the counts of 8 equal ranges of gray."""
    at = np.arange(len(samples))[:, None] * 8 + (samples >> 5)
    return np.bincount(at.reshape(-1), minlength=8 * len(samples)).reshape(-1, 8)


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    raw, off = utf8(batch.column(1))
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media: the files themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            media = gif.write_many(to_gifs(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), type=pa.int64()), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_slices(run), "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the digests of what the files give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(digests(*(batch.column(k).to_pylist() for k in range(3))), schema=ARROW)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(by_slices(run), SCHEMA)


def frames(stored: DataFrame) -> DataFrame:
    """(doc_id, media) -> a row for each timed frame: doc_id, frame, delay (hundredths of a second), disposal, transparent (index or null), histogram of what is shown, samples as shown."""
    schema = "doc_id long, frame int, delay int, disposal int, transparent int, histogram array<long>, samples binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("delay", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("histogram", pa.list_(pa.int64())), ("samples", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, file in zip(batch.column(0).to_pylist(), gif.read_many(batch.column(1).to_pylist()), strict=True):
                samples = shown_samples(file)
                for k, (f, s, h) in enumerate(zip(file.frames, samples, histograms(samples), strict=True)):
                    rows.append({"doc_id": i, "frame": k, "delay": f.delay, "disposal": f.disposal, "transparent": f.transparent, "histogram": h.tolist(), "samples": s.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return stored.select("doc_id", "media").mapInArrow(by_slices(run), schema)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digests(ids: list, sizes: list, media: list[bytes]) -> list[dict]:
    """The digest columns of files, from what they give back. feature: the counts of 8 ranges of gray over all frames, the number of frames, their time, and how many differ in histogram."""
    out = []
    for doc_id, n_bytes, stored, file in zip(ids, sizes, media, gif.read_many(media), strict=True):
        samples = shown_samples(file)
        each = histograms(samples)
        payload = samples.tobytes()
        time = sum(f.delay for f in file.frames)
        out.append(
            {
                "doc_id": doc_id,
                "n_bytes": n_bytes,
                "payload_bytes": len(payload),
                "payload_sha256": hashlib.sha256(payload).hexdigest(),
                "tail_crc32": zlib.crc32(payload[-32:]),
                "media_bytes": len(stored),
                "media_sha256": hashlib.sha256(stored).hexdigest(),
                "feature": ":".join(map(str, [*each.sum(axis=0).tolist(), len(each), time, len(set(map(bytes, each.astype("<u2"))))])),
            }
        )
    return out


def media_digests(docs: DataFrame) -> DataFrame:
    """Store and read back in one pass over the rows, so that no stored file crosses a process boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            media = gif.write_many(to_gifs(texts))
            yield pa.RecordBatch.from_pylist(digests(batch.column(0).to_pylist(), list(map(len, texts)), media), schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_slices(run), SCHEMA)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_media": op6_media}
ORACLES: dict[str, str] = {}
