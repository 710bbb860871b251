"""Substring dedup by paragraph MinHash banding.

Paragraphs are cut by content, so that a passage gives the same ones wherever it stands: within a line, over line breaks, at any offset. After a word there is a cut if its
key is the smallest among the AROUND words to either side; ends of sentences and lines have smaller keys than other words, and equal keys all cut. A paragraph is what lies between
two cuts, some 11 words; its place is its number in the text. A passage of more than 50 words holds one in whole nearly always (measured in tests/llm/test_paragraphs.py).

Each paragraph of MIN_WORDS words or more gets a MinHash of BANDS x ROWS values over its five-word shingles. 4 bands of 2 rows find a pair of similarity 0.8 with probability
1 - (1 - 0.8^2)^4 = 0.983, one of 0.9 with 0.9987, and equal ones always. Paragraphs that collide in a band are joined, compared in full (Jaccard 0.8 or more) and clustered by components (see linking). Of each
cluster the first paragraph (by doc_id, then place) stays; all others are removed, with the white space after them. A shorter one goes if it has the shingles of an earlier one and
stands beside a paragraph that goes: alone it says too little to be a copy.

Scale: texts are read once by vectors into a table of paragraphs with their bands; what is shuffled is a row for each band of each paragraph, aggregated first, then ids of equal
paragraphs. A second reading of that table lets out only the bands that stand in several paragraphs. Common bands go through hubs and sketches, never through all pairs. Only texts that lose something are joined.

Null or empty text, or none but white space: no paragraphs, nothing removed. Null doc_id: nothing is removed from such rows, and they are no one's first. Repeated rows: equal
(doc_id, place, content) stay or go together. Ties: the smallest (doc_id, place) stays. Very long texts are a slice of their own, in memory of some 100 bytes for each byte. An empty table
gives an empty one. clean_texts() keeps all columns but n_removed, which gives way to its own; helper columns take free names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.common import by_slices, fresh, has_bits, key_bits, materialize, may_have, mix64, table, utf8
from tallgrass.llm.linking import in_several, link, only_wanted, sketch, small_sketch
from tallgrass.llm.shingles import sets_of, shingle_hashes, words_of

BANDS, ROWS, MIN_WORDS, AROUND = 4, 2, 6, 7
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = ~np.uint64(0)
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".!?:;")] = True


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    best, step = values, 1
    while step * 2 <= width:
        best, step = np.minimum(best[:-step], best[step:]), step * 2
    rest = width - step
    return np.minimum(best[:-rest], best[rest:]) if rest else best


def _names(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(at) < 2:
        return np.zeros(0, dtype=np.int64)
    return mix64(np.add.reduceat(mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[:-1])).view(np.int64)


class Paragraphs:
    """The paragraphs of documents that lie end to end: document, place, first and next byte, number of words; and the words' hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, around: int = AROUND):
        words, starts, ends, bounds = words_of(raw, off)
        n = len(words)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
        lines = np.concatenate([[0], np.cumsum(raw == 10)])
        after = np.append(starts[1:], len(raw))[:n]
        mark = _MARKS[raw[ends]] | (lines[after] > lines[ends + 1]) if n else np.zeros(0, dtype=bool)
        key = mix64(words * np.uint64(3)) >> np.uint64(2)
        key[1:] ^= np.where(owner[1:] == owner[:-1], mix64(words[:-1] * np.uint64(5)) >> np.uint64(2), np.uint64(0))
        key |= (~mark).astype(np.uint64) << np.uint64(63)
        # documents apart by more than a window, so that no neighbour in the batch matters
        at = np.arange(n) + around * (owner + 1)
        row = np.full(n + around * (len(off) + 1), _TOP)
        row[at] = key
        cut = key == _window_min(row, 2 * around + 1)[at - around] if n else mark
        cut[bounds[1:][np.diff(bounds) > 0] - 1] = True
        last = np.flatnonzero(cut)
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        self.words, self.bounds = words, np.append(first, n)
        self.doc, self.size = owner[first], last - first + 1
        self.place = np.arange(len(first)) - np.searchsorted(self.doc, np.arange(len(off)))[self.doc] if len(first) else first
        same = np.append(self.doc[1:] == self.doc[:-1], False) if len(first) else mark
        self.start = starts[first]
        self.stop = np.where(same, np.append(self.start[1:], 0), off[self.doc + 1]) if len(first) else first
        self.end = ends[last] + 1

    @cached_property
    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        return shingle_hashes(self.words, self.bounds)

    @cached_property
    def sid(self) -> np.ndarray:
        """A name for the shingles of each, with their number of times."""
        return _names(*self.shingles)

    def sids(self, which: np.ndarray) -> np.ndarray:
        """The names of some alone."""
        size = self.size[which]
        ends = np.cumsum(size)
        if not len(which):
            return np.zeros(0, dtype=np.int64)
        at = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(self.bounds[:-1][which], size)
        return _names(*shingle_hashes(self.words[at], np.concatenate([[0], ends])))

    def bands(self) -> pa.Array:
        """For each paragraph that is long enough a 64-bit key for each band, as bytes; for others none. Shingles are hashes, so multiplying by an odd number and folding permutes them afresh."""
        long = self.size >= MIN_WORDS
        values, at = self.shingles
        keys = np.zeros((int(long.sum()), BANDS), dtype=np.uint64)
        for band in range(BANDS if len(keys) else 0):
            key = np.full(len(keys), np.uint64(band + 1) * np.uint64(0x1E3779B97F4A7C15))
            for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                folded = values * seed
                folded ^= folded >> np.uint64(29)
                key = mix64(key ^ np.minimum.reduceat(folded, at[:-1])[long])
            keys[:, band] = key
        ends = np.concatenate([[0], np.cumsum(long * (8 * BANDS))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(ends), pa.py_buffer(keys)])


def _of_batch(column: pa.Array) -> tuple[np.ndarray, Paragraphs]:
    raw, off = utf8(column)
    return raw, Paragraphs(raw, off)


def _numbers(some: pa.StructArray, name: str) -> np.ndarray:
    return some.field(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _listed(lists: pa.Array, p: Paragraphs) -> tuple[np.ndarray, pa.StructArray]:
    """The numbers of listed paragraphs among those of a batch, and what is listed of each; places that a text doesn't have are left out. Null lists are empty."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    begin = np.searchsorted(p.doc, np.arange(len(lists) + 1))
    some = lists.flatten()
    at = begin[owner] + _numbers(some, "place")
    there = at < begin[owner + 1]
    return at[there], some.filter(pa.array(there))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, place, sid, short, bands) of every paragraph of docs (doc_id, text); sid names its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _of_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(p.doc)), pa.array(p.place.astype(np.int32)), pa.array(p.sid), pa.array(p.size < MIN_WORDS), p.bands()], names=["doc_id", "place", "sid", "short", "bands"])

    return docs.mapInArrow(by_slices(run), "doc_id long, place int, sid long, short boolean, bands binary")


def bands_of(every: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(token, id): a row for each band of each paragraph, id being its sid; with `some` (token), all rows of these tokens and few others."""
    shared = None if some is None else every.sparkSession.sparkContext.broadcast(key_bits(some, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary()).buffers()
            off = np.frombuffer(raw[1], dtype=np.int64, count=batch.num_rows + 1 + batch.column(1).offset)[batch.column(1).offset :]
            keys = np.frombuffer(raw[2] or b"", dtype=np.int64)[off[0] // 8 : off[-1] // 8]
            sids = np.repeat(np.asarray(batch.column(0)), np.diff(off) // 8)
            if shared is not None:
                keep = has_bits(shared.value, keys)
                keys, sids = keys[keep], sids[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sids)], names=["token", "id"])

    return every.where("NOT short").select("sid", "bands").mapInArrow(by_slices(run), "token long, id long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of paragraphs: wanted (doc_id, place, id) says where each stands first."""
    of_doc = wanted.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("place", F.col("id").alias("sid"))).alias("wanted"))
    source = only_wanted(docs.select(F.col("doc_id").alias("id"), "text"), of_doc.select("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, p = _of_batch(batch.column(0))
            which, some = _listed(batch.column(1), p)
            want = _numbers(some, "sid")
            # rows that share an id may differ
            same = p.sids(which) == want
            begin, size = p.start[which[same]], (p.end - p.start)[which[same]]
            ends = np.concatenate([[0], np.cumsum(size)])
            data = raw[np.arange(int(ends[-1])) + np.repeat(begin - ends[:-1], size)]
            texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(want[same], pa.int64()), texts], names=["id", "text"])

    return source.join(of_doc.hint("merge"), "id").select("text", "wanted").mapInArrow(by_slices(run), "id long, text string").dropDuplicates(["id"])


def _sketches(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of(batch.column(1)))
            cells = [sketch(v) for v in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in sets], pa.int64()), pa.array(cells, pa.binary()), pa.array([small_sketch(c) for c in cells], pa.binary())], names=["id", "n", "sketch", "small"])

    return texts.mapInArrow(by_slices(run), "id long, n long, sketch binary, small binary")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, place, sid, short): paragraphs that repeat an earlier one, exactly or nearly; of short ones all that repeat exactly, wherever they stand."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    every = materialize(paragraphs(docs), "op5-paragraphs")
    place = F.struct("doc_id", "place")
    classes = materialize(every.groupBy("sid").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("short").alias("short")), "op5-classes")
    several = materialize(in_several(bands_of(every), "token", "id"), "op5-tokens")
    # written before they are made distinct: a join without an aggregate behind it can split a hot token's rows
    shared = materialize(bands_of(every, several).join(several.hint("merge"), "token"), "op5-shared")
    buckets = materialize(shared.distinct(), "op5-buckets")
    met = classes.where(may_have(docs.sparkSession, buckets.select("id"))(F.col("sid"))).join(buckets.select(F.col("id").alias("sid")).distinct().hint("merge"), "sid")
    texts = materialize(_texts(docs, met.select("first.doc_id", "first.place", F.col("sid").alias("id"))), "op5-texts")
    labels, _ = link(buckets, texts, materialize(_sketches(texts), "op5-sketches"))
    labels = materialize(labels, "op5-labels")
    # classes that stand at several places or are linked to others; of all others the only place stays
    linked = labels.select(F.col("id").alias("sid"), "label")
    heads = classes.where(may_have(docs.sparkSession, linked.select("sid"))(F.col("sid"))).join(linked.hint("merge"), "sid").groupBy("label").agg(F.min("first").alias("head"))
    near = linked.join(heads, "label").select("sid", "head")
    same = classes.where("first <> last").join(linked.select("sid").hint("merge"), "sid", "left_anti").select("sid", F.col("first").alias("head"))
    owner = materialize(near.unionByName(same), "op5-owners")
    some = every.where(may_have(docs.sparkSession, owner.select("sid"))(F.col("sid")))
    return some.join(owner.hint("merge"), "sid").where(place != F.col("head")).select("doc_id", "place", "sid", "short")


def clean_texts(docs: DataFrame) -> DataFrame:
    """Rows of docs with `text` less its repeated paragraphs, and n_removed, their number. A text that loses none stays as it is and where it is."""
    gone = materialize(removals(docs), "op5-removals")
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "n_removed"])
    key, places = fresh("_doc", docs.columns), fresh("_places", docs.columns)
    # a text changes only where a paragraph that is not short goes
    of_doc = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("place", "sid", "short")).alias(places)).where(F.exists(places, lambda x: ~x["short"]))
    of_doc = materialize(of_doc, "op5-of-doc")
    flag = may_have(docs.sparkSession, of_doc.select(key))(F.col("doc_id"))
    touched = docs.where(flag).join(of_doc.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    at, last = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(at).cast(pa.string()))
            p = Paragraphs(raw, off)
            which, some = _listed(batch.column(last), p)
            same = p.sids(which) == _numbers(some, "sid")
            gone = _going(p, which[same], which[same & (_numbers(some, "short") == 0)])
            keep = _outside(len(raw), p.start[gone], p.stop[gone])
            texts, removed = batch.column(at).to_pylist(), np.bincount(p.doc[gone], minlength=batch.num_rows)
            for i in np.flatnonzero(removed).tolist():
                texts[i] = raw[off[i] : off[i + 1]][keep[off[i] : off[i + 1]]].tobytes().decode()
            columns = [*batch.columns[:last], pa.array(removed)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:last], "n_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())])
    return docs.where(~flag).withColumn("n_removed", F.lit(0).cast("long")).unionByName(touched.mapInArrow(by_slices(run), schema))


def _going(p: Paragraphs, found: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Of the paragraphs that are found again those that go: solid ones, and all that stand with one in an unbroken row of found ones."""
    is_found, row = np.zeros(len(p.doc), dtype=bool), np.zeros(len(p.doc), dtype=np.int64)
    is_found[found] = True
    row[1:] = np.cumsum(~(is_found[1:] & is_found[:-1] & (p.doc[1:] == p.doc[:-1])))
    has = np.zeros(len(p.doc), dtype=bool)
    has[row[solid]] = True
    return np.flatnonzero(is_found & has[row])


def _outside(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in none of these ranges, which don't overlap."""
    step = np.zeros(n + 1, dtype=np.int8)
    step[starts] += 1
    step[stops] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) == 0


def paragraph_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, kept_bytes, kept_sha256 of what is left of each text."""
    out = clean_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    kept = F.col("text").cast("binary")
    return out.select("doc_id", "n_removed", F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_report(table(spark, sf_dir, "documents"))


QUERIES = {"op5_paragraphs": op5_paragraphs}
ORACLES: dict[str, str] = {}
