import hashlib
import random

from tallgrass.llm import op4_lines as op


def all_spans(text, long_words):
    """Straight from the definition, without fingerprints."""
    lines = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
    for i, (k, x) in enumerate(lines):
        if len(lines) == 1 or len(x.split()) >= long_words:
            yield [k], (x,)
        elif i + 1 < len(lines):
            yield [k, lines[i + 1][0]], (x, lines[i + 1][1])


def brute(rows, long_words):
    first, gone = {}, set()
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    every = [(i, places, content) for i, t in docs for places, content in all_spans(t, long_words)]
    for i, places, content in every:
        first[content] = min(first.get(content, (i, places[0])), (i, places[0]))
    for i, places, content in every:
        if (i, places[0]) != first[content]:
            gone |= {(i, k) for k in places}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [k for k in range(len(lines)) if (i, k) in gone]
        solid = [k for k, x in enumerate(lines) if x.strip()]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else t or ""
        out.append((i, len(solid), len(drop), len(kept.encode()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["alpha", "beta gamma", " beta gamma ", "", "delta", "é", "one two three four five", "\t"]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"line {rng.randrange(60)}" for _ in range(rng.randrange(7))]
        if rng.random() < 0.3:
            lines.append(f"a long line number {rng.randrange(8)} of many words")
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, rows[3][1]), (3, rows[3][1]), (203, "only one"), (204, " only one"), (205, "x\nx\nx\nx\n\nx")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, op.line_report(docs, 6).collect()), key=str)
    assert got == brute(rows, 6)
    kept = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in op.clean_texts(docs, 6).collect()}
    assert kept == {r[4] for r in got}


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb", 3, "p"), (2, "a\nb\nc", 5, "q"), (None, None, None, None)], "doc_id long, text string, n_chars long, place string")
    got = op.clean_texts(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "a\nb", 3, "p"), (2, "c", 1, "q"), (None, None, None, None)]
    assert op.line_report(docs.limit(0)).count() == 0 and op.clean_texts(docs.limit(0)).count() == 0


def repeated_runs(rows, long_words):
    """Lines of later repeated runs, by comparing every two places line by line as far as they agree: runs of two lines or more, of one long line, or a text's only line."""
    docs = {i: [(k, x.strip()) for k, x in enumerate(t.split("\n")) if x.strip()] for i, t in rows}
    places = [(i, n) for i in sorted(docs) for n in range(len(docs[i]))]
    gone = set()
    for a in places:
        for b in places:
            if a < b:
                x, y = docs[a[0]][a[1] :], docs[b[0]][b[1] :]
                size = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p[1] != q[1]), min(len(x), len(y)))
                only = len(docs[a[0]]) == len(docs[b[0]]) == 1
                if size >= 2 or (size == 1 and (only or len(x[0][1].split()) >= long_words)):
                    gone |= {(b[0], k) for k, _ in y[:size]}
    return gone


def test_a_short_line_after_a_long_one(spark):
    long, other = "a long line of seven plain words", "another long line of seven plain words"
    rows = [(1, f"x\n{long}\nshort"), (2, f"y\n{long}\nshort"), (3, f"{long}\nshort\nz"), (4, f"{other}\n\n{long}\nshort"), (5, f"{long}\nnew"), (6, "short"), (7, f"{other}\n{long}\nnew\nshort")]
    rng = random.Random(3)
    rows += [(i, "\n".join(rng.choice([long, other, "p", "q", "r", f"only {i}"]) for _ in range(rng.randrange(1, 7)))) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.place) for r in op.removals(docs, 6).collect()}
    assert {(2, 1), (2, 2), (3, 0), (3, 1), (4, 2), (4, 3)} <= got and (5, 1) not in got
    assert got == repeated_runs(rows, 6)
