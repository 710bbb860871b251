import hashlib
import random
import re

from tallgrass.llm import op9_pii as op

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-"), "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def want(i, text):
    spans = base(text)
    joined = ",".join(f"{op.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (i, *[sum(k == j for _, k, _ in spans) for j in range(4)], hashlib.sha256(joined.encode()).hexdigest()), joined


HARD = [None, "", "a@b.c", "a@b-c.d_e@f.g", "x..y@a..b a@b.c.", "é@b.de, 日x@y.zz 😀q@r.st", "1.2.3.4.5.6.7.8 1.2.3.256 0001.2.3.4 99999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "4111111111111111 5  6", "+1 (743) 555-3824, +12 34 +1-2-3-4-5-6-7-8-9", "+49 30 1234567 1.2.3.4", "a@b.c@d.e.f", "@a.b a@", "12 34 56 78 90 12 34 56 78 9", "john [at] mail [dot] example (dot) org call (743) 555-3824", "  ab@c.d 4111", "%@-.-", "5" * 5000, "1 " * 5000, "a." * 5000 + "b@c" + ".d" * 5000, "1.2.3.4 " * 300]


def rows():
    rng = random.Random(9)
    texts = list(HARD)
    for _ in range(400):
        texts.append("".join(rng.choice(["a", "é", "😀", " ", " ", "@", ".", ".", "-", "+", "(", ")", "1", "23", "456", "\n", "x@y.z", "4111 1111 1111 1111", "+1 (743) 555-3824", "9.8.7.6"]) for _ in range(rng.randrange(30))))
    return list(enumerate(texts))


def test_base_spans_against_brute_force(spark):
    data = [*rows(), (None, "a@b.c"), (2, "a@b.c")]
    got = op.pii_report(spark.createDataFrame([(i, t, "e") for i, t in data], "doc_id long, text string, base string")).collect()
    expected = [want(i, t) for i, t in data]
    assert sorted((tuple(r[:6]) for r in got), key=str) == sorted((w for w, _ in expected), key=str)
    joined = {}
    for w, j in expected:
        joined.setdefault(w[0], set()).add(j)
    for r in got:  # base spans stay
        assert any(set(filter(None, j.split(","))) <= set(r.spans.split(",")) for j in joined[r.doc_id])


def test_trees_learn_and_add(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(600):
        d = [rng.randrange(10) for _ in range(15)]
        full = next("".join(map(str, d)) + str(c) for c in range(10) if luhn("".join(map(str, d)) + str(c)))
        texts.append("card " + " ".join(full[k : k + 4] for k in range(0, 16, 4)))
        texts.append("order " + "".join(str(rng.randrange(10)) for _ in range(rng.choice([6, 8, 9]))))
    odd = "card 4111 1111 1111 1112 ok"
    docs = spark.createDataFrame([*enumerate(texts), (5000, odd)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.pii_report(docs).collect()}
    assert got[5000].n_card == 0 and got[5000].spans == "card:5:24"
    assert all(got[i].spans == "" for i in range(1, 1200, 2))


def test_empty_table(spark):
    assert op.pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.spans for r in op.pii_report(spark.createDataFrame([(1, "none here")], "doc_id long, text string")).collect()] == [""]


def test_added_spans_against_planted_ones(spark):
    """Numbers written like cards, whose check digit is wrong, and phones without a plus sign, among decoys: precision and recall of what the trees add."""
    rng = random.Random(5)
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    rows, planted, decoys = [], {}, set()
    for i in range(900):
        kind = i % 6
        if kind == 0:
            d = digits(15)
            rows.append((i, "pay " + next(d + str(c) for c in range(10) if luhn(d + str(c))) + " now"))
        elif kind == 1:
            d = digits(15)
            rows.append((i, "pay " + next(d + str(c) for c in range(10) if not luhn(d + str(c))) + " now"))
            planted[i] = "card:4:20"
        elif kind == 2:
            rows.append((i, f"call +1 ({digits(3)}) 555-{digits(4)} today"))
        elif kind == 3:
            rows.append((i, f"call ({digits(3)}) 555-{digits(4)} today"))
            planted[i] = "phone:5:19"
        elif kind == 4:
            rows.append((i, f"order {digits(rng.choice([5, 7, 8, 9]))} of {digits(3)}.{digits(3)}.{rng.randrange(300, 999)}.{digits(2)}"))
            decoys.add(i)
        else:
            rows.append((i, f"host {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} up"))
    got = {r.doc_id: r for r in op.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(planted[i] in got[i].spans.split(",") for i in planted)
    assert found >= 0.9 * len(planted)
    assert sum(got[i].n_spans for i in decoys) <= 0.05 * len(decoys)
    assert all(got[i].n_card == 0 for i in planted)


def test_spans_go_beyond_the_base_on_the_corpus(spark):
    rows = op.op9_pii(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_spans for r in rows) > sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    added = [x.split(":") for r in rows for x in r.spans.split(",") if x]
    assert {k for k, _, _ in added} <= set(op.KINDS)
