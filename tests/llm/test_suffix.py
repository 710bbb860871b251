import hashlib
import random

import numpy as np
import pytest

from tallgrass.llm import op8_suffix as op
from tallgrass.llm import repeats


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            raw = (t or "").encode()
            for s in range(len(raw) - 49):
                w = raw[s : s + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for s in range(len(raw) - 49) if i is not None else ():
            if first[raw[s : s + 50]] < i:
                gone[s : s + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "aa", "b", "zebra", "\n", "\x00", "日本"]) if rng.random() < 0.6 else f"w{rng.randrange(50)}"
    passages = [" ".join(word() for _ in range(rng.randrange(12, 60))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(25)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts.append(p if rng.random() < 0.5 else p[cut:])
            parts.append(" ".join(word() for _ in range(rng.randrange(8))))
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, "a" * 300), (501, "b" * 49), (502, "a" * 50), (503, "a" * 49), (504, "ab" * 100), (505, "ba" * 60), (7, None), (8, ""), (None, rows[1][1]), (3, rows[1][1]), (900, rows[5][1]), (901, rows[5][1] + rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [400, 4 << 20])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(op, "GROUP_BYTES", size)
    monkeypatch.setattr(op, "BUCKET_BYTES", size * 8)
    monkeypatch.setattr(op, "CHUNK_BYTES", 2000)
    rows = texts(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, op.suffix_report(docs).collect()), key=str)
    assert got == brute(rows)
    kept = sorted(hashlib.sha256(r.kept).hexdigest() for r in op.kept_bytes(docs).collect())
    assert kept == sorted(r[4] for r in got)


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 80, 3), (2, "x" * 60, 4)], "doc_id long, text string, g long")
    assert sorted((r.doc_id, r.n_removed) for r in op.suffix_report(docs).collect()) == [(1, 0), (2, 60)]
    assert op.suffix_report(docs.limit(0)).count() == 0


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(4)
    for _ in range(40):
        raw = bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(5, 60)))
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = np.arange(len(raw))
        left = np.where(starts == 0, -1, data[np.maximum(starts, 1) - 1])
        got = {raw[s[0] : s[0] + n]: sorted(starts[s].tolist()) for n, found in repeats.maximal_repeats(data, starts, len(raw) - starts, left, 3) for s in [found]}
        want = {}
        for n in range(3, len(raw)):
            for s in range(len(raw) - n + 1):
                x = raw[s : s + n]
                at = [k for k in range(len(raw) - n + 1) if raw[k : k + n] == x]
                lefts, rights = {raw[k - 1] if k else -1 for k in at}, {raw[k + n] if k + n < len(raw) else -1 for k in at}
                if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                    want[x] = at
        assert got == want
