"""Line dedup by winnowing over line hashes.

Lines are compared without white space at their ends; blank lines are neither compared nor removed. A span is the shortest run of lines worth removing: one line of
LONG_WORDS words or more, two lines that follow each other, or the only line of a document. A line goes if it lies in a span whose lines also form a span at
an earlier place (smaller doc_id, or further up in the same document). Spans that overlap or touch make up the removed runs.

Winnowing: of each span the smallest line hash (the leftmost of equals) is its fingerprint, so two equal spans always have equal fingerprints. Fingerprints and their
positions are joined first; only where a fingerprint stands at two places are the spans around it, to both sides, compared. Every two neighbours are a span,
long lines or not, so consecutive matching spans extend a match over the whole of a repeated run.

Scale: what is shuffled is a row for each fingerprint with the spans around it, then the spans of fingerprints that repeat. Both are aggregated before the
shuffle (first place, last place), and the result joined back, where a hot line's rows can be split. Texts move once, to lose their lines.

Null or empty text: no lines, nothing removed. Null doc_id: left as it is, and no one's first. Repeated rows (one id): equal places are one place, so both stay or
both lose a line. clean_texts() keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import by_slices, fresh, held, materialize, table, without_lines

LONG_WORDS = 30
BLANK = " \t\n\x0b\x0c\r"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("key", pa.int64())]))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def spans(text: str, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes, int, int]]:
    """(first line, last line, content, fingerprint, fingerprint's line) of every span of a text."""
    lines = [(k, x) for k, line in enumerate(text.split("\n")) if (x := line.strip(BLANK))]
    hashed = [_hash(x.encode()) for _, x in lines]
    out = []
    for i, (k, line) in enumerate(lines):
        if len(lines) == 1 or (len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words):
            out.append((k, k, b"1" + line.encode(), hashed[i], k))
        if i + 1 < len(lines):
            j, other = lines[i + 1]
            low = i if hashed[i] <= hashed[i + 1] else i + 1
            out.append((k, j, b"2" + line.encode() + b"\n" + other.encode(), hashed[low], lines[low][0]))
    return out


def fingerprints(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(fp, doc_id, pos, spans: array of (start, stop, key)): each selected line with the spans that selected it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("op4", dict)  # what earlier operators keep goes
        for batch in batches:
            rows: dict[str, list] = {"fp": [], "doc_id": [], "pos": [], "spans": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[tuple[int, int], list] = {}
                for start, stop, content, fp, pos in spans(text or "", long_words):
                    found.setdefault((fp, pos), []).append({"start": start, "stop": stop, "key": _hash(content)})
                for (fp, pos), around in found.items():
                    for name, value in zip(rows, (fp, doc_id, pos, around), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows["fp"], pa.int64()), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["pos"], pa.int32()), pa.array(rows["spans"], _SPAN)], names=list(rows))

    return docs.mapInArrow(by_slices(run), "fp long, doc_id long, pos int, spans array<struct<start: int, stop: int, key: long>>")


def removals(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, place): lines that lie in a span which stands at an earlier place too."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    selected = materialize(fingerprints(docs, long_words), "op4-fingerprints")
    place = F.struct("doc_id", "pos")
    # what is aggregated is written first: a join that has nothing to aggregate can split a hot key's rows
    again = materialize(selected.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp"), "op4-again")
    around = materialize(selected.join(again.hint("merge"), "fp").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*"), "op4-spans")
    first = materialize(around.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first")), "op4-first")
    later = around.join(first.hint("merge"), "key").where(F.struct("doc_id", "start") != F.col("first"))
    return later.select("doc_id", F.explode(F.array_distinct(F.array("start", "stop"))).alias("place")).distinct()


def clean_texts(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """Rows of docs with `text` less its repeated lines; n_chars, where there is one, follows."""
    gone = fresh("_gone", docs.columns)
    out = without_lines(docs, materialize(removals(docs, long_words), "op4-removals"), gone)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop(gone)


def line_report(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_bytes, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    solid = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")))
    out = without_lines(docs.withColumn("n_lines", solid.cast("long")), materialize(removals(docs, long_words), "op4-removals"), "n_removed")
    kept = F.col("text").cast("binary")
    return out.select("doc_id", "n_lines", F.col("n_removed").cast("long").alias("n_removed"), F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lines": op4_lines}
ORACLES: dict[str, str] = {}
