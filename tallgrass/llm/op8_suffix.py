"""Suffix-array dedup: every byte goes that a string of 50 bytes covers which also starts in a document with a smaller doc_id.

1. Documents are dealt into groups of about GROUP_BYTES by a hash of their id; all later steps meet their texts there (one shuffle of the texts, reused).
2. Every string of 50 bytes stands under a fingerprint: the smallest hash of its 16-byte grams (the leftmost of equals). Equal strings have equal fingerprints. A group
   sends its distinct fingerprints, as sorted and compressed blocks, to where equal ones meet; what stands in several documents comes back.
3. For such fingerprints a group sends the bytes that their strings cover (50 to 84), each distinct piece once with the smallest doc_id that has it. Pieces are dealt by
   ranges of fingerprints and searched in chunks; in each chunk the common-prefix interval tree of an enhanced suffix array (see repeats) gives the maximal repeats with all their
   occurrences, and so the smallest doc_id of each. Pieces of equal bytes are one leaf of the tree.
4. Repeats that stand in a smaller document come back to their group; with the pieces that a group holds several times itself (compared byte by byte) they cover the bytes to remove.

Scale: nothing but texts, fingerprints (a quarter of a byte for each byte of text) and pieces of repeated places is shuffled; equal pieces meet as one row for each group, so that a
passage that a third of all documents share doesn't land in one task. Groups and buckets have a bounded size, their number grows with the input; blocks between them are sent
only where they hold something, so there are never more than fingerprints.

Null or empty text: nothing to remove. Null doc_id: nothing is removed there, and it is no one's smaller document. Repeated rows of one doc_id don't remove from each
other. Strings are judged on the input, overlaps count, and matches never cross documents. Ties can't arise: only whether a smaller doc_id has a string matters. A very long text is a group
of its own size. An empty table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import mix64, release, table, utf8
from tallgrass.llm.repeats import LENGTH, Selected, maximal_repeats

GROUP_BYTES, BUCKET_BYTES, CHUNK_BYTES, BITS, CHOICES = 6 << 20, 12 << 20, 1 << 20, 48, 12
_FINGERPRINTS = "bucket int, g int, n_single int, single binary, n_several int, several binary"
_PIECES = "bucket int, g int, rows int, packed binary"
_FOUND = "g int, key long, doc_id long, start int, stop int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
NO_ID = np.iinfo(np.int64).max


def _documents(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids (NO_ID where there is none) of a group's rows, and whether a row has an id."""
    raw, off = utf8(rows.column("text"))
    ids = rows.column("doc_id").combine_chunks() if isinstance(rows.column("doc_id"), pa.ChunkedArray) else rows.column("doc_id")
    known = np.asarray(ids.is_valid())
    return raw, off, np.asarray(ids.fill_null(NO_ID)), known


def _select(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Selected, np.ndarray]:
    raw, off, ids, known = _documents(rows)
    chosen = Selected(raw, off)
    keep = known[chosen.doc] if len(chosen.doc) else np.zeros(0, dtype=bool)
    # selected hashes are small ones, so they are mixed again to spread over the buckets; shorter ones pack better, and two grams that share one only make a candidate more
    chosen.hash = mix64(chosen.hash ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    for name in ("place", "hash", "doc", "first", "last", "key"):
        setattr(chosen, name, getattr(chosen, name)[keep])
    return raw, off, ids, chosen, known


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def bucket_keys(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket such that Spark's hash deals them evenly over as many tasks: of CHOICES numbers, the one whose task has fewest."""
    hashed = [r.t for r in spark.range(CHOICES * buckets).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("t")).collect()]
    load, keys = [0] * buckets, []
    for b in range(buckets):
        some = range(CHOICES * b, CHOICES * (b + 1))
        keys.append(min(some, key=lambda k: load[hashed[k]]))
        load[hashed[keys[-1]]] += 1
    return keys


def _cuts(sorted_hashes: np.ndarray, buckets: int) -> list[int]:
    """Buckets are ranges of hashes, so each is a slice."""
    edges = [(b << BITS) // buckets for b in range(1, buckets)]
    return [0, *np.searchsorted(sorted_hashes, np.array(edges, dtype=np.uint64)).tolist(), len(sorted_hashes)]


def _runs(values: np.ndarray) -> np.ndarray:
    """First places of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _fingerprints(keys: list[int]):
    buckets = len(keys)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, _, ids, chosen, _ = _select(rows)
        order = np.lexsort([ids[chosen.doc], chosen.hash])
        h, d = chosen.hash[order], ids[chosen.doc][order]
        starts = _runs(h)
        low = np.minimum.reduceat(d, starts) if len(starts) else d
        high = np.maximum.reduceat(d, starts) if len(starts) else d
        h, several = h[starts], low != high
        cuts = _cuts(h, buckets)
        one, more = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            one.append(h[s:e][~several[s:e]])
            more.append(h[s:e][several[s:e]])
        # no rows for empty slices: with many buckets there are no more rows than fingerprints
        full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        columns = [pa.array([keys[b] for b in full], pa.int32()), pa.array([key[0].as_py()] * len(full), pa.int32())]
        for part in (one, more):
            columns += [pa.array([len(part[b]) for b in full], pa.int32()), pa.array([pack(part[b]) for b in full], pa.binary())]
        return pa.table(columns, names=["bucket", "g", "n_single", "single", "n_several", "several"])

    return run


def _common(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For each group, those of its fingerprints that stand in several documents, here or elsewhere."""
    groups = rows.column("g").to_pylist()
    single, several = ([unpack(b, n) for b, n in zip(rows.column(k).to_pylist(), rows.column(f"n_{k}").to_pylist(), strict=True)] for k in ("single", "several"))
    every = np.sort(np.concatenate([*single, *several, *several]))
    starts = _runs(every)
    common = every[starts][np.diff(np.append(starts, len(every))) > 1]
    out = []
    for a, b in zip(single, several, strict=True):
        if len(common) and len(a):
            at = np.minimum(np.searchsorted(common, a), len(common) - 1)
            a = a[common[at] == a]
        else:
            a = a[:0]
        out.append(np.sort(np.concatenate([a, b])))
    return pa.table([pa.array(groups, pa.int32()), pa.array([len(x) for x in out], pa.int32()), pa.array([pack(x) for x in out], pa.binary())], names=["g", "n", "common"])


def _pieces(keys: list[int]):
    buckets = len(keys)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, common: pa.Table) -> pa.Table:
        """The bytes around each common fingerprint, every distinct piece once with the smallest doc_id that has it, compressed for each bucket."""
        raw, _, ids, chosen, _ = _select(rows)
        wanted = np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack(b, n) for b, n in zip(common.column("common").to_pylist(), common.column("n").to_pylist(), strict=True))]))
        keep = np.zeros(len(chosen.hash), dtype=bool)
        if len(wanted):
            keep = wanted[np.minimum(np.searchsorted(wanted, chosen.hash), len(wanted) - 1)] == chosen.hash
        k, d, first, last, h = (x[keep] for x in (chosen.key, ids[chosen.doc], chosen.first, chosen.last, chosen.hash))
        order = np.lexsort([d, k, h])
        order = order[_runs(k[order])] if len(order) else order
        k, d, first, last, h = (x[order] for x in (k, d, first, last, h))
        data, cuts = raw.tobytes(), _cuts(h, buckets)
        packed = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            head = b"".join(np.ascontiguousarray(x[s:e].view(np.uint8).reshape(-1, 8).T).tobytes() for x in (h, k, d))
            sizes = (last[s:e] - first[s:e] + LENGTH).astype(np.uint8).tobytes()
            text = b"".join(data[a : b + LENGTH] for a, b in zip(first[s:e].tolist(), last[s:e].tolist(), strict=True))
            packed.append(pa.compress(head + sizes + text, codec="zstd", asbytes=True) if e > s else b"")
        full = [b for b in range(buckets) if packed[b]]
        n = np.diff(cuts)
        # the number of rows and the size before compression, in one
        return pa.table([pa.array([keys[b] for b in full], pa.int32()), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array([int(n[b]) for b in full], pa.int32()), pa.array([_size(last, first, cuts, b).to_bytes(8, "little") + packed[b] for b in full], pa.binary())], names=["bucket", "g", "rows", "packed"])

    return run


def _size(last: np.ndarray, first: np.ndarray, cuts: list[int], b: int) -> int:
    s, e = cuts[b], cuts[b + 1]
    return 25 * (e - s) + int((last[s:e] - first[s:e] + LENGTH).sum())


def _search(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """All pieces of a bucket in order of fingerprints, searched in chunks that end between two of them."""
    parts = []
    for g, n, packed in zip(*(rows.column(c).to_pylist() for c in ("g", "rows", "packed")), strict=True):
        data = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        h, k, d = (np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=8 * n, offset=8 * n * i).reshape(8, n).T).view(np.int64).reshape(-1) for i in range(3))
        sizes = np.frombuffer(data, dtype=np.uint8, count=n, offset=24 * n).astype(np.int32)
        text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data[25 * n :])])
        parts.append(pa.table([pa.array(h), pa.array(np.full(n, g, dtype=np.int32)), pa.array(k), pa.array(d), text], names=["fp", "g", "key", "doc_id", "piece"]))
    every = pa.concat_tables(parts)
    order = np.argsort(every.column("fp").to_numpy(), kind="stable")
    fp = every.column("fp").to_numpy()[order]
    size = np.cumsum(pa.compute.binary_length(every.column("piece")).to_numpy()[order])
    starts = _runs(fp)
    out, begin = [], 0
    for cut in [*starts[1:].tolist(), len(fp)]:
        if size[cut - 1] - (size[begin - 1] if begin else 0) >= CHUNK_BYTES or cut == len(fp):
            out.append(_repeats(every.take(pa.array(order[begin:cut]))))
            begin = cut
    del every, parts
    try:
        return pa.concat_tables(out)
    finally:
        release()


def _repeats(chunk: pa.Table) -> pa.Table:
    """Places in pieces that a smaller document holds as well.

    Pieces of equal bytes are one leaf of the tree, with the copies as its occurrences. All rows of a leaf but those of its smallest document repeat it in whole; what its smallest document
    shares with other leaves the intervals tell. A leaf that is alone under its fingerprint has no interval above it, as equal strings have equal fingerprints.
    """
    doc, fp = chunk.column("doc_id").to_numpy(), chunk.column("fp").to_numpy()
    encoded = chunk.column("piece").combine_chunks().dictionary_encode()
    leaf, texts = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.cast(pa.large_binary())
    order = np.lexsort([doc, leaf])
    head = order[_runs(leaf[order])]  # of each leaf, the row of its smallest document
    low, fp_of = doc[head], fp[head]
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    again = np.flatnonzero(doc > low[leaf])
    out: dict[str, list] = {"row": [again], "start": [np.zeros(len(again), dtype=np.int64)], "stop": [off[leaf[again] + 1] - off[leaf[again]]]}
    # leaves of fingerprints that have several
    by = np.argsort(fp_of, kind="stable")
    runs = _runs(fp_of[by])
    many = np.sort(by[np.repeat(np.diff(np.append(runs, len(by))) > 1, np.diff(np.append(runs, len(by))))]) if len(by) else by
    counts = off[many + 1] - off[many] - LENGTH + 1
    owner = np.repeat(many, counts)
    starts = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + off[owner]
    left = np.where(starts == off[owner], -1 - np.arange(len(starts)), data[np.maximum(starts, 1) - 1].astype(np.int64)) if len(starts) else starts
    for depth, found in maximal_repeats(data, starts, off[owner + 1] - starts, left):
        lows = low[owner[found]]
        later = found[lows > lows.min()]
        if len(later):
            out["row"].append(head[owner[later]])
            at = starts[later] - off[owner[later]]
            out["start"].append(at)
            out["stop"].append(at + depth)
    rows, start, stop = (np.concatenate(x) for x in out.values())
    # touching and overlapping places of one piece become one
    order = np.lexsort([start, rows])
    rows, start, stop = rows[order], start[order], stop[order]
    if len(rows):
        span = 1 << 20
        reach = np.maximum.accumulate(stop + rows * span)
        new = np.concatenate([[True], (rows[1:] * span + start[1:]) > reach[:-1]])
        cut = np.flatnonzero(new)
        stop = np.append(reach[cut[1:] - 1], reach[-1]) - rows[cut] * span
        rows, start = rows[cut], start[cut]
    taken = chunk.select(["g", "key", "doc_id"]).take(pa.array(rows))
    return pa.table([*taken.columns, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["g", "key", "doc_id", "start", "stop"])


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the byte ranges of `size` from a and from b are not equal."""
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 1 << 14):
        n = size[s : s + (1 << 14)]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        other = raw[np.repeat(a[s : s + len(n)], n) + step] != raw[np.repeat(b[s : s + len(n)], n) + step]
        out[s : s + len(n)] = np.logical_or.reduceat(other, ends - n)
    return out


def _covered(rows: pa.Table, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, and which bytes go."""
    raw, off, ids, chosen, known = _select(rows)
    d = ids[chosen.doc]
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    # pieces that a smaller document of this group holds too
    order = np.lexsort([d, chosen.key])
    starts = _runs(chosen.key[order])
    first = np.repeat(order[starts], np.diff(np.append(starts, len(order)))) if len(starts) else order
    later = d[order] > d[first]
    again, first = order[later], first[later]
    # the name of a piece proposes, its bytes decide
    if len(again):
        again = again[~_differ(raw, chosen.first[again], chosen.first[first], chosen.last[again] - chosen.first[again] + LENGTH)]
    np.add.at(edge, chosen.first[again], 1)
    np.add.at(edge, chosen.last[again] + LENGTH, -1)
    # places that came back belong to every row of their document with that piece
    if found.num_rows and len(order):
        key, doc = found.column("key").to_numpy().view(np.uint64), found.column("doc_id").to_numpy()
        start, stop = found.column("start").to_numpy(), found.column("stop").to_numpy()
        sorted_keys = chosen.key[order]
        lo, hi = np.searchsorted(sorted_keys, key, side="left"), np.searchsorted(sorted_keys, key, side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(key)), n)
        at = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        mine = d[at] == doc[which]
        at, which = at[mine], which[mine]
        np.add.at(edge, chosen.first[at] + start[which], 1)
        np.add.at(edge, chosen.first[at] + stop[which], -1)
    return raw, off, np.cumsum(edge[:-1]) > 0, known


def _results(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
    raw, off, gone, _ = _covered(rows, found)
    total = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[off[:-1][off[:-1] < len(raw)]] |= gone[off[:-1][off[:-1] < len(raw)]]
    spans = np.concatenate([[0], np.cumsum(begins)])
    digests = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        part = raw[a:b] if total[a] == total[b] else raw[a:b][~gone[a:b]]
        digests.append(hashlib.sha256(part).hexdigest())
    at, to = off[:-1], off[1:]
    return pa.table([rows.column("doc_id"), pa.array(to - at), pa.array(total[to] - total[at]), pa.array(spans[to] - spans[at]), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_texts(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
    raw, off, gone, _ = _covered(rows, found)
    kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return pa.table([rows.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])


def _dealt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their group, places found elsewhere)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // BUCKET_BYTES))
    texts = docs.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)).cast("int").alias("g"), "doc_id", "text").repartition("g")
    # packed blocks are small for the work that they hold, so there are as many tasks as buckets, each with one or two
    keys = bucket_keys(docs.sparkSession, buckets)
    common = texts.groupBy("g").applyInArrow(_fingerprints(keys), _FINGERPRINTS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_common, "g int, n int, common binary")
    pieces = texts.groupBy("g").cogroup(common.groupBy("g")).applyInArrow(_pieces(keys), _PIECES)
    found = pieces.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_search, _FOUND)
    return texts, found


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, found = _dealt(docs)
    return texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_results, RESULT)


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, kept: what is left of each text, as bytes."""
    texts, found = _dealt(docs)
    return texts.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_kept_texts, "doc_id long, kept binary")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix": op8_suffix}
ORACLES: dict[str, str] = {}
