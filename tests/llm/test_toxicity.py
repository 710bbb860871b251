import itertools
import random
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from tallgrass.llm import calibration
from tallgrass.llm import op3_toxicity as op
from tallgrass.llm.common import table
from tallgrass.llm.deobfuscate import CONTEXTS, ORDER, PLAIN, SIZE, SPACED, TOKEN, CharModel, Decoder, _class, disguises, gram_codes, options

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    """Under the model of the corpus as it is."""
    return Decoder(op.char_model(table(spark, SMALL, "documents")))


@pytest.mark.parametrize(("seen", "word"), [("w0rthl3ss", "worthless"), ("worthlesss", "worthless"), ("woorthless", "worthless"), ("w0rthl3$s", "worthless"), ("worthless", "worthless"), ("1d10t", "idiot"), ("idiooot", "idiot"), ("cl0wn", "clown"), ("p@thet1c", "pathetic"), ("i" * 5000 + "diot", "idiot"), ("pathetic$", "pathetic")])
def test_restores_on_the_corpus_model(decoder, seen, word):
    assert decoder.word(seen) == word


@pytest.mark.parametrize("text", ["w o r t h l e s s", "w  o  r  t  h  l  e  s  s", "w.o-r_t*h l e s s", "w 0 r t h l 3 s s", "w oo r t h l e s s".replace("oo", "o o")])
def test_spaced_words(decoder, text):
    assert "worthless" in decoder.words(f"you are {text}!")
    assert {"clown", "idiot"} <= decoder.words("a c l o w n  i d i o t")


def test_a_small_model_restores_what_it_knows():
    text = "kill the fucking fuck and kill the stupid letter " * 50
    codes, counts = np.unique(gram_codes(text), return_counts=True)
    d = Decoder(CharModel(codes, counts))
    assert [d.word(w) for w in ("k1ll", "fuuck", "st0pid", "stuuupid", "kill", "letter", "l3tter")] == ["kill", "fuck", "stopid", "stupid", "kill", "letter", "letter"]


def price(table, word):
    total, x = 0, 0
    for letter in [*map(_class, word), 0]:
        total += table[x * SIZE + letter]
        x = (x * SIZE + letter) % CONTEXTS
    return total


def test_viterbi_is_the_cheapest_path(decoder):
    rng = random.Random(1)
    for _ in range(150):
        token = "".join(rng.choice("01345aeiost$") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        runs = [(k, len(list(g))) for k, g in groupby(token)]
        choices = [options(sign, min(n, 3), k in (0, len(runs) - 1)) for k, (sign, n) in enumerate(runs)]
        found = {}
        for path in itertools.product(*choices):
            word = "".join(p[0] for p in path)
            total = price(decoder.table, word) + sum(p[2] for p in path)
            found[word] = min(found.get(word, 1 << 30), total)
        assert found[decoder.decode(token)] == min(found.values())


def test_model_counts_runs_and_backs_off():
    codes, counts = np.unique(gram_codes("Ab áb1b"), return_counts=True)
    place = lambda *c: sum(x * SIZE**k for k, x in enumerate(reversed(c)))
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {place(1): 2, place(1, 2): 2, place(1, 2, 0): 2, place(2): 1, place(2, 0): 1}
    t = np.frombuffer(CharModel(codes, counts).table, dtype=np.uint8).reshape(-1, SIZE)
    assert t.shape == (SIZE ** (ORDER - 1), SIZE) and t[place(1), 2] < t[place(1), 3] and t[place(5, 1), 2] < t[place(5, 1), 3]


def test_letter_runs_hold_those_that_occur():
    from tests.llm.test_common import peak_of

    texts = ["the cat sat, " * 50, None, "", "Straße 東京 the hat"]
    batches = [pa.RecordBatch.from_pydict({"text": texts[k:]}) for k in (0, 2, 3)] + [pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    found, peak = peak_of(lambda: list(op.letter_runs(iter(batches))))
    want = np.concatenate([gram_codes("  ".join(t or "" for t in texts[k:]).lower()) for k in (0, 2, 3)])
    codes, counts = np.unique(want, return_counts=True)
    assert [c for b in found for c in b.column(0).to_pylist()] == codes.tolist() and [n for b in found for n in b.column(1).to_pylist()] == counts.tolist()
    assert peak < 1 << 24
    assert not list(op.letter_runs(iter([])))


def test_plain_texts_are_known_for_certain():
    rng = random.Random(4)
    signs = list("ab") + ["é", "ß", " ", " ", ".", "-", "_", "1", "@", "$", "!", "|", "€", "¡", "—", " ", "́", "日", "×", "\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(5000)] + [None, ""]
    noisy, spaced = disguises(pa.array(texts))
    for x, n, s in zip(texts, noisy, spaced, strict=True):
        x = (x or "").lower()
        if not s:
            assert SPACED.search(x) is None, x
        if not n:
            assert {t for t in TOKEN.findall(x) if any(map(str.isalpha, t))} == set(PLAIN.findall(x)), x


def test_scores_against_brute_force(spark):
    """Scores straight from their definition: no filters, nothing remembered, each text by itself."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = op.fit(docs, labels)
    got = {r.doc_id: r.score for r in op.with_scores(docs.select("doc_id", "text"), model, "score").collect()}
    decoder = Decoder(model.chars)
    for r in docs.where("doc_id % 7 = 0").collect():
        weights = sorted((max([model.weights.get(w, 0)] + [model.weights.get(w[:k] + "*", 0) for k in op.STEMS if len(w) > k]) for w in decoder.words(r.text or "")), reverse=True)
        z = np.array([sum(weights[: op.STRONGEST])])
        assert got[r.doc_id] == pytest.approx(float(np.clip(calibration.apply(model.knots, z), 0, 1)[0]), abs=1e-12)


def test_held_out_accuracy(spark):
    got = op.op3_toxicity(spark, SMALL)
    both = got.join(table(spark, SMALL, "labels"), "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.toxic).mean() > 0.9
    assert both[both.toxic == 0].predicted.mean() < 0.05


def test_disguised_documents_go_and_clean_ones_stay(spark):
    labels = table(spark, SMALL, "labels")
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    plants = ["the 1d10t and the cl0wn are p@thet1c and w0rthl3ss", "an i d i o t, a c.l.o.w.n and p a t h e t i c w o r t h l e s s", "idiooot cloown patheetic worthlesss"]
    more = spark.createDataFrame([(10_000_000 + i, x) for i, x in enumerate(plants)] + [(20_000_000, "the of and here that with thing")], "doc_id long, text string")
    kept = {r.doc_id for r in op.clean_documents(docs.unionByName(more), labels).where("doc_id >= 10000000").collect()}
    assert kept == {20_000_000}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0, 1.0), (None, "a 1d10t", 1, None), (2, "", 2, 2.0), (2, "", 2, 2.0), (3, "x" * 100_000 + " 1" * 20_000 + " a" * 20_000, 3, 3.0)], "doc_id long, text string, score int, _toxicity double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = op.toxicity_scores(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.0}
    kept = op.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5 and kept.where("_toxicity = 2").count() == 2
    assert op.toxicity_scores(docs.limit(0), labels).count() == 0
