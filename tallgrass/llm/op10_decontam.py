"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions alone.

Items are cut into windows of ten words (a shorter item is one window). The words of a window are ordered by rarity, counted over all documents. A window can lie
in a document only if the document holds the window's rarest word, so that word is its necessary prefix: documents keep the positions of such words with the
words around them, and join the windows on it. The length bound and the positional bound (the window has to fit around the position where its rarest word stands)
leave few pairs, whose words are then compared one by one.

Scale: documents are read twice and never shuffled whole; what is shuffled are candidate positions with at most 19 words. Words to look for reach the scan as a
constant set of at most SET_WORDS; larger benchmarks are looked for in blocks of that many, each a further pass. A frequent word is a prefix only where all
words of a window are as frequent, and then its occurrences are dealt over tasks by an extra salt.

Null text or text without words: n_words 0, no hits. Null doc_id: counted like any other row. Repeated rows give repeated results. Items that are null, without
words or without an id are left out; repeated items count once. An empty benchmark contaminates nothing. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import materialize, table

WINDOW = 10
SET_WORDS = 20_000
SALT = 16
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    """Words of a text, lower-cased in A-Z only; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATOR), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window: array of words), each pair once."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id"), words_of("text").alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.select("item_id", "w", F.explode(at).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(size)).alias("window")).distinct()


def _blocks(words: DataFrame) -> list[list[str]]:
    """The distinct words in blocks that are small enough to be a constant of a scan."""
    n = words.count()
    if n == 0:
        return []
    blocks = -(-n // (SET_WORDS // 2)) if n > SET_WORDS else 1
    return [[r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).collect()] for b in range(blocks)]


def rarity(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, df): in how many documents each of these words stands."""
    found = None
    for block in _blocks(words):
        have = docs.select(F.explode(F.array_distinct(F.filter(words_of("text"), lambda w: w.isin(block)))).alias("word"))
        counts = have.groupBy("word").agg(F.count("*").alias("df"))
        found = counts if found is None else found.unionByName(counts)
    return found


def prefixes(windows: DataFrame, df: DataFrame) -> DataFrame:
    """(window, word, offset): the rarest word of each window that occurs at all, and where it first stands. Windows with a word that no document holds go: they can't occur."""
    each = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    ranked = each.join(df, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "offset")).alias("m"))
    return ranked.where("m.df > 0").select("window", "m.word", "m.offset", "m.df")


def positions(docs: DataFrame, words: list[str], size: int = WINDOW) -> Column:
    """Where these words stand in a document: (pos, word, first, around), around holding the words from `first` to size - 1 behind pos."""
    hits = F.filter(F.transform(F.col("w"), lambda w, i: F.when(w.isin(words), i)), lambda i: i.isNotNull())
    first = lambda i: F.greatest(i - (size - 1), F.lit(0))
    return F.transform(hits, lambda i: F.struct(i.alias("pos"), F.get(F.col("w"), i).alias("word"), first(i).alias("first"), F.slice(F.col("w"), first(i) + 1, i - first(i) + size).alias("around")))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Documents with their number of words, and every place where a window stands: (doc_id, h, start, len, window). h tells apart texts of one id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    windows = materialize(item_windows(benchmark, size), "op10-windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    df = rarity(docs, vocabulary)
    counted = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of("text").alias("w"))
    if df is None:
        none = counted.select("doc_id", "h", F.lit(0).alias("start"), F.lit(0).alias("len"), F.array(F.lit("")).alias("window")).where(F.lit(False))
        return counted.select("doc_id", "h", F.size("w").cast("long").alias("n_words")), none
    prefix = materialize(prefixes(windows, df), "op10-prefixes")
    base, found = None, []
    for block in _blocks(prefix.select("word").distinct()) or [[""]]:
        seen = materialize(counted.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), positions(counted, block, size).alias("at")), "op10-positions")
        base = seen.select("doc_id", "h", "n_words") if base is None else base
        found.append(seen.select("doc_id", "h", F.explode("at").alias("p")).select("doc_id", "h", "p.*"))
    at = found[0]
    for more in found[1:]:
        at = at.unionByName(more)
    # a window's rarest word can still be frequent: its places are dealt by a salt, its windows repeated for each
    at = at.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALT)))
    dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("df") > 10_000, F.lit(SALT - 1)).otherwise(F.lit(0))))).withColumn("hot", F.col("df") > 10_000)
    hot = dealt.where("hot").select("word").distinct()
    at = at.join(hot.withColumn("is_hot", F.lit(True)), "word", "left").withColumn("salt", F.when(F.col("is_hot"), F.col("salt")).otherwise(F.lit(0))).drop("is_hot")
    pairs = at.join(dealt.drop("hot", "df"), ["word", "salt"])
    start, n = F.col("pos") - F.col("offset"), F.size("window")
    fits = (start >= F.col("first")) & (start + n <= F.col("first") + F.size("around"))
    same = F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, n) == F.col("window")
    return base, pairs.where(fits).where(same).select("doc_id", "h", start.alias("start"), n.alias("len"), "window")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base, places = occurrences(docs, benchmark, size)
    places = materialize(places.distinct(), "op10-places")
    windows = item_windows(benchmark, size)
    words = places.select("doc_id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("i")).distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    items = places.select("doc_id", "h", "window").distinct().join(windows, "window").select("doc_id", "h", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("doc_id", "h").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    hits = words.join(items, words["doc_id"].eqNullSafe(items["doc_id"]) & (words["h"] == items["h"])).select(words["doc_id"].alias("d"), words["h"].alias("k"), "n_hit", "n_items", "items_sha256")
    out = base.join(hits, base["doc_id"].eqNullSafe(hits["d"]) & (base["h"] == hits["k"]), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window stands, all columns kept."""
    _, places = occurrences(docs, benchmark, size)
    bad = materialize(places.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct(), "op10-bad")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_d"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(bad["_h"])
    return docs.join(bad, same, "left_anti")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(it.s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

QUERIES = {"op10_decontam": op10_decontam}
ORACLES = {"op10_decontam": SQL}
