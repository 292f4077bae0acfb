import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from corvine.llm import langid, textops, toxicity
from corvine.llm.tables import held_out
from tests.llm.conftest import table

LANGS = {"en": "the and of with from that which there have this".split(), "de": "der und nicht mit eine auch schön über große straße".split(), "fr": "le et avec une dans être français où très déjà".split()}


def rows(n):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        out.append((i, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(3, 60))), lang, "s"))
    return out


def test_words_and_their_hashes():
    texts = ["One two, two", None, "", "élan vital-two", "x" * 3_000_000 + " two"]
    buf, offsets = textops.utf8(pa.array(texts), lower=True)
    start, end, doc, h = textops.words(buf, offsets)
    got = [(int(d), bytes(buf[s:e]).decode()) for d, s, e in zip(doc[:6], start[:6], end[:6], strict=True)]
    assert got == [(0, "one"), (0, "two"), (0, "two"), (3, "élan"), (3, "vital"), (3, "two")]
    assert h[1] == h[2] == h[5] == h[-1] and len(set(h[:6].tolist())) == 4


def test_languages_are_told_apart_on_held_out_documents(spark):
    data = rows(600)
    docs = table(spark, [*data, (1000, None, "en", "s"), (1001, "12 34 !?", "en", "s"), (1002, "", None, "s")])
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(got) == 603
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(got[d[0]].held_out for d in held)
    assert sum(got[d[0]].lang_pred == d[2] for d in held) / len(held) > 0.97
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())


def test_codewords_differ():
    for n in (2, 3, 4, 7, 30):
        book = langid.codebook(n)
        assert min((book[a] != book[b]).sum() for a in range(n) for b in range(a)) >= (1 if n == 2 else 2)


def test_toxic_words_and_compounds_are_learned(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        words = [rng.choice(sum(LANGS.values(), [])) for _ in range(40)]
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["vileword", "grimling"]) if i % 2 else "mudstem" + rng.choice("abcdefghij") * 2
        data.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    docs = table(spark, [*data, (2000, None, None, None), (2001, "", "en", "s")])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [x for x in labels if got[x[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.97
    assert got[2000].score == got[2001].score and len(model[0]) < 5000
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_nothing_to_learn_from(spark, odd, none):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (odd, none):
        assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()} <= {0}
        assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.filter("lang IS NULL"))).collect()} <= {"und"}
    assert langid.predict(odd, langid.fit(odd)).count() == odd.count()
    assert np.isfinite([r.score for r in langid.predict(odd, langid.fit(odd)).collect()]).all()


def test_long_words_hash_alike_wherever_they_stand():
    word = "x" * 1_500_000
    buf, offsets = textops.utf8(pa.array([word, "a " + word, "b" * 700_000 + " " + word + "z", word + " " + word]), lower=True)
    _, _, doc, h, head = textops.words(buf, offsets, (5,))
    own = {(int(d), int(x)) for d, x in zip(doc, h, strict=True)}
    assert len(h) == 7 and h[0] == h[2] == h[5] == h[6] != h[4] and len(own) == 6 and head[0] == head[4]


def scalar_grams(text):
    """The features of a text, one at a time."""
    m = 2**64

    def mix(h, seed=0):
        h ^= (seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % m
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % m
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % m
        return h ^ (h >> 31)

    raw = lambda w: sum((b + 1) * pow(0x9E3779B97F4A7C15, i + 1, m) for i, b in enumerate(w)) % m
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
    shift = 64 - toxicity.BITS
    h = [mix(raw(w)) for w in words]
    out = {mix(x, 1) >> shift for x in h} | {mix(raw(w[:k]), k) >> shift for w in words for k in toxicity.STEMS}
    for skip in (1, 2):
        out |= {mix((a * 0xC2B2AE3D27D4EB4F + b) % m, 1 + skip) >> shift for a, b in zip(h, h[skip:], strict=False)}
    return out


def test_toxicity_equals_a_scalar_learner(spark):
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(sum(LANGS.values(), []) + ["vile", "grim"] * (i % 3 == 0)) for _ in range(rng.randint(0, 25))), "en", "s") for i in range(120)]
    marks = [(i, int(i % 3 == 0)) for i in range(120) if i % 7]
    docs = table(spark, data)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", held_out().alias("h")).collect()}
    feats = {i: scalar_grams(t) for i, t, *_ in data}
    rows, alpha, beta, l1, l2 = [(feats[i], y) for i, y in marks if not held[i]], 0.6, 1.0, 8.0, 0.1
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(f):
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - (l1 if v > 0 else -l1)) / ((beta + n.get(f, 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(6):
        for i in order.permutation(len(rows)):
            own, y = rows[i]
            w = {f: weight(f) for f in own}
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - y
            for f in own:
                s = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + g - s * w[f]
                n[f] = n.get(f, 0.0) + g * g
            s = (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha
            zb, nb = zb + g - s * wb, nb + g * g
    bias = -zb / ((beta + nb**0.5) / alpha)
    for i, own in feats.items():
        p = 1 / (1 + math.exp(-(bias + sum(map(weight, own)))))
        assert abs(got[i].score - p) < 1e-9 and got[i].predicted == int(p >= 0.5) and got[i].held_out == held[i]


def test_languages_equal_a_plain_decoder(spark):
    docs = table(spark, rows(150))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text, *_ in rows(150):
        counts = np.zeros(langid.DIM)
        folded = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
        for k in (2, 3):
            for at in range(len(folded) - k + 1):
                c = folded[at : at + k]
                x = (c[0] * 0x9E3779B1 % 2**32) ^ (c[1] * 0x85EBCA77 % 2**32)
                x = (x * 0xC2B2AE3D % 2**32) ^ (c[2] * 0x27D4EB2F % 2**32) if k == 3 else x
                counts[((x ^ (x >> 15)) >> 5) % langid.DIM] += 1
        v = np.sqrt(counts) / np.sqrt(counts.sum())
        margins = v @ model.weights + model.bias
        losses = [sum(t * math.log1p(math.exp(-c * m)) for c, m, t in zip(code, margins, trust, strict=True)) for code, trust in zip(model.codes, model.trust, strict=True)]
        p = np.exp(-(np.array(losses) - min(losses)) * model.codes.shape[1])
        p /= p.sum()
        assert got[i].lang_pred == model.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def test_repeated_ids_learn_the_same_in_any_order(spark):
    data = rows(200) + [(7, "und nicht mit eine auch", "zz", "s"), (8, "the and of", "aa", "s")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    a, b = table(spark, data), table(spark, data[::-1]).repartition(3)
    assert np.array_equal(langid.fit(a).weights, langid.fit(b).weights) and langid.fit(a).languages == langid.fit(b).languages
    x, y = toxicity.fit(a, marks), toxicity.fit(b, marks)
    assert np.array_equal(x[0], y[0]) and np.allclose(x[1], y[1], rtol=0, atol=0) and x[2] == y[2]
