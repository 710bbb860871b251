"""From buckets of possibly similar texts to components of texts whose shingle sets are similar, without pairs of whole groups.

A bucket is a key that similar texts share: a prefix token or a MinHash band. Every member of a bucket is first compared with the bucket's best hub
(the member with the largest share of its keys in common with others), or else with its neighbour in that order. Components of the links found so far leave few buckets whose
members are not yet connected. In those, members of different components are compared by small count sketches: the difference of two sketches never exceeds the
difference of the sets, so a pair whose sketches lie too far apart cannot be similar; every other pair is compared in full. So no link between components is
missed among texts that share a bucket, and a group of near copies costs a few comparisons for each member.

Hot hubs and large buckets are dealt over tasks: a hub's comparisons by salt, a bucket's by blocks of members. Intermediate tables lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import by_slices, materialize, may_have, mix64
from tallgrass.llm.shingles import sets_of, shared

#: Similarity at least NUMERATOR / 100; bytes of a sketch and of a small one; members of a block; comparisons of a hub in one task.
NUMERATOR, SKETCH, SMALL, BLOCK, PER_SALT = 80, 256, 64, 2048, 256
#: Tokens and members of a block of a component whose members' partners are counted; cells of a table of tokens at once.
BLOCK_TOKENS, BLOCK_MEMBERS, CELLS = 1 << 19, 1024, 1 << 23


def prefix_size(n: int) -> int:
    """So many first tokens, in any order, of a set of n share one with those of any similar set."""
    return n - (NUMERATOR * n + 99) // 100 + 1


def sketch(values: np.ndarray) -> bytes:
    """How many tokens fall into each of SKETCH cells, at most 255."""
    return np.minimum(np.bincount((values >> np.uint64(7)) & np.uint64(SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def small_sketch(cells: bytes) -> bytes:
    """The same with SMALL cells."""
    return np.minimum(np.frombuffer(cells, dtype=np.uint8).reshape(-1, SMALL).sum(axis=0), 255).astype(np.uint8).tobytes()


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that sizes and small sketches allow to be similar: cheap rows instead of texts are moved for the others."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("small").alias("sa"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("small").alias("sb"))
    size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * NUMERATOR
    # sorted and merged at every size: what is moved is two small rows for each pair
    both = pairs.distinct().join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(size).select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, SMALL).astype(np.int16) for k in (3, 4))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            near = apart * (100 + NUMERATOR) <= (100 - NUMERATOR) * np.asarray(batch.column(2))
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact."""
    if min(len(a), len(b)) * 100 < NUMERATOR * max(len(a), len(b)):
        return False
    both = shared(a, b)
    return 100 * both >= NUMERATOR * (len(a) + len(b) - both)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        key = tuple(c[0] for c in columns)
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def only_wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts (id, text) that can have one of these ids: all that have, and few others."""
    texts = texts.where("id IS NOT NULL").select("id", "text")
    return texts.where(may_have(texts.sparkSession, ids)(F.col("id")))


def in_several(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of rows (key, value) that stand with different values. Aggregated before the shuffle, so that a hot key is one row for each task."""
    return rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi").select(key)


def _orders_agree(a: tuple, b: tuple) -> bool:
    return all(shared(x, y) > 0 for x, y in zip(a, b, strict=True))


def other_prefixes(values: np.ndarray, orders: int) -> tuple[np.ndarray, ...]:
    """The prefixes of a set under further global orders."""
    out, p = [], prefix_size(len(values))
    for k in range(orders):
        ranks = mix64(values + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        out.append(np.sort(values[np.argpartition(ranks, p - 1)[:p]] if p < len(values) else values))
    return tuple(out)


def verified(pairs: DataFrame, texts: DataFrame, orders: int = 0) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar. texts: (id, text, sid), where sid tells which of several texts of one id is meant. With orders, a pair has to share prefix tokens under each of so many further orders before it is compared."""
    pairs = materialize(pairs.distinct(), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    dealt = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = materialize(dealt.unionByName(hubs), "rows")
    source = only_wanted(texts, rows.select("id").distinct())
    moved = rows.join(source.hint("merge"), "id").select("a", "salt", "role", "id", "text")
    moved = moved.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub, hub_prefixes = None, None, None
        for batch in batches:
            a, salt, role, ids = (np.asarray(batch.column(k)) for k in range(4))
            left, right = [], []
            for i, values in enumerate(sets_of(batch.column(4))):
                at = (a[i], salt[i])
                if role[i] == 0:
                    if key != at:
                        key, hub, hub_prefixes = at, [], []
                    hub.append(values)
                    hub_prefixes.append(other_prefixes(values, orders) if len(values) else ())
                elif key == at and len(values):
                    own = other_prefixes(values, orders)
                    if any(len(h) and _orders_agree(p, own) and similar(h, values) for h, p in zip(hub, hub_prefixes, strict=True)):
                        left.append(a[i])
                        right.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])

    return materialize(moved.mapInArrow(by_slices(run), "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of edges (a, b): label is the smallest id of its component. Labels travel to neighbours and along themselves, so rounds grow with the logarithm of a component's width."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialize(step.join(over, "label", "left").select("id", "old", F.least("label", "further").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def crossing(buckets: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one bucket (token, id) that lie in different components and whose sizes and sketches (id, n, sketch) allow them to be similar."""
    known = materialize(buckets.join(labels, "id", "left").select("token", "id", F.coalesce("label", "id").alias("label")), "known")
    size = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("token", "blocks")
    open_ = materialize(known.join(size.hint("merge"), "token").select("token", "id", "label", "blocks"), "open")
    rows = open_.join(sketches.select("id", "n", "sketch").hint("merge"), "id")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "label", "n", "sketch")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "mine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            mine, ids, label, n = (group.column(k).to_numpy() for k in range(3, 7))
            cells = np.stack([np.frombuffer(x.as_py(), dtype=np.uint8) for x in group.column(7)]).astype(np.int16)
            for s in range(0, len(ids), 64):
                some = slice(s, s + 64)
                ok = label[some, None] != label[None, :]
                ok &= (mine[some, None] == i) & (mine[None, :] == j)
                if i == j:
                    ok &= np.arange(s, min(s + 64, len(ids)))[:, None] < np.arange(len(ids))[None, :]
                both = n[some, None] + n[None, :]
                ok &= np.minimum(n[some, None], n[None, :]) * 100 >= NUMERATOR * np.maximum(n[some, None], n[None, :])
                x, y = np.nonzero(ok)
                # |difference| <= (1 - t) / (1 + t) of the sum of sizes
                for k in range(0, len(x), 8192):
                    p, q = x[k : k + 8192], y[k : k + 8192]
                    apart = np.abs(cells[some][p] - cells[q]).sum(axis=1, dtype=np.int64)
                    keep = apart * (100 + NUMERATOR) <= (100 - NUMERATOR) * both[p, q]
                    one, two = ids[some][p[keep]], ids[q[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets that left names with those that right names."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times > 1
    place = np.cumsum(some) - 1
    owner, code = owner[some[code]], place[code[some[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out, width, total = np.zeros((len(left), len(right)), dtype=np.float32), max(1, CELLS // len(sets)), int(some.sum())
    for s in range(0, total, width):
        a, b = np.searchsorted(code, [s, s + width])
        has = np.zeros((len(sets), min(width, total - s)), dtype=np.float32)
        has[owner[a:b], code[a:b] - s] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def partners(labels: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, n_links): with how many other ids of its component (id, label) each id is similar, exactly. texts: (id, text); sizes: (id, n).

    Similar ids are always in one component, and two alone in theirs are linked. Larger components are dealt in blocks of members; every pair of blocks is compared in one
    task by a product of matrices and leaves one row for each member, never a pair.
    """
    members = labels.join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id")
    whole = members.groupBy("label").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = materialize(labels.join(whole, "label"), "members")
    two = dealt.where("size = 2").select("id", F.lit(1).cast("long").alias("n_links"))
    more = dealt.where("size > 2").select("label", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine"))
    source = only_wanted(texts, more.select("id").distinct())
    rows = more.join(source.hint("merge"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "text")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            mine, ids = group.column(3).to_numpy(), group.column(4).to_numpy()
            sets = list(sets_of(group.column(5)))
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            if not len(left) or not len(right):
                continue
            n = np.array([len(x) for x in sets])
            both, sums = overlaps(sets, left, right), n[left][:, None] + n[right][None, :]
            x, y = np.nonzero((both > 0) & (100 * both >= NUMERATOR * (sums - both)))
            one, p = np.unique(ids[left], return_inverse=True)
            other, q = np.unique(ids[right], return_inverse=True)
            hit = np.zeros((len(one), len(other)), dtype=bool)
            hit[p[x], q[y]] = True
            if i == j:
                np.fill_diagonal(hit, False)
            found = [(one, hit.sum(axis=1))] + ([(other, hit.sum(axis=0))] if i < j else [])
            for who, times in found:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(times.astype(np.int64))], names=["id", "n"])

    counted = rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    return counted.unionByName(two)


def link(buckets: DataFrame, texts: DataFrame, sketches: DataFrame, orders: int = 0) -> tuple[DataFrame, DataFrame]:
    """(labels, links): components (id, label) and the links (a, b) that make them, of texts (id, text) that share a bucket (token, id). sketches: (id, n, sketch, small)."""
    buckets = materialize(buckets, "buckets")
    score = buckets.groupBy("id").agg(F.count("*").alias("keys")).join(sketches.select("id", "n"), "id").select("id", (F.col("keys") / F.greatest("n", F.lit(1))).alias("score"))
    scored = materialize(buckets.join(score, "id"), "scored")
    best = scored.groupBy("token").agg(F.max(F.struct("score", F.bitwise_not("id").alias("no"))).alias("best"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = scored.join(best.select("token", F.bitwise_not("best.no").alias("hub"), "blocks").hint("merge"), "token")
    # neighbours within a block of a bucket, so that no task holds a whole one
    w = Window.partitionBy("token", "block").orderBy(F.desc("score"), "id")
    dealt = dealt.select("token", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "score", "hub")
    near = materialize(dealt.select(F.col("id").alias("b"), "hub", F.lag("id").over(w).alias("neighbour")), "near")
    hubs = materialize(plausible(near.where("hub <> b").select(F.col("hub").alias("a"), "b"), sketches), "hubs")
    # a neighbour is tried where no hub can be similar
    left = near.where("neighbour IS NOT NULL").select(F.col("neighbour").alias("a"), "b").join(hubs.select("b").distinct(), "b", "left_anti")
    links = verified(hubs.unionByName(plausible(left.select("a", "b"), sketches)), texts, orders)
    labels = components(links)
    more = verified(crossing(buckets, labels, sketches), texts, orders)
    links = links.unionByName(more)
    if more.isEmpty():
        return labels, links
    return components(links), links

