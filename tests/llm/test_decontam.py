import hashlib
import random
import re

from tallgrass.llm import op10_decontam as op


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        if i is not None and w:
            for s in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, seen = words(text), set(), set()
        for s in range(len(w)):
            for n in range(1, 11):
                if s + n <= len(w) and (found := windows.get(tuple(w[s : s + n]))):
                    hit.update(range(s, s + n))
                    seen |= found
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, docs, items):
    got = op.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.collect())) == order(brute(docs, items))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "É", "é", "x1", "b", "c", "d", "e2", "word"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) if rng.random() < 0.8 else f"w{rng.randrange(200)}" for _ in range(n))
    items = [(i, text(rng.choice([2, 5, 9, 10, 11, 25]))) for i in range(25)] + [(3, "The THE the"), (None, "the"), (90, None), (91, " ,.! "), (92, "É é")]
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    docs += [(100 + i, text(15) + " " + items[i][1].upper() + " " + text(9)) for i in range(20)] + [(7, docs[7][1]), (7, "other"), (None, items[4][1]), (200, None), (201, ""), (202, "... !!")]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [(1, "a b c")], [])
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [(1, "no such words")])


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "SET_WORDS", 8)
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(14))) for i in range(6)]
    docs = [(i, " ".join(["q", items[i % 6][1], "z"]) if i % 2 else f"w{i} w{i + 1}") for i in range(12)]
    check(spark, docs, items)


def test_clean_documents_keeps_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "s"), (2, "nothing here", "s"), (None, None, "t")], "doc_id long, text string, h string")
    items = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    assert sorted(op.clean_documents(docs, items).collect(), key=str) == sorted(docs.where("doc_id IS NULL OR doc_id = 2").collect(), key=str)
