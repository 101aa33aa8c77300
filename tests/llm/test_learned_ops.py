"""Language identification and toxicity: held-out accuracy, and awkward rows."""

import itertools
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import language, queries, toxicity


@pytest.fixture(scope="module")
def larger():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    return path


def test_languages_of_held_out_texts(spark, larger):
    found = queries.QUERIES["op7_language_id"](spark, larger)
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("der und die nicht", "de"), ("the and of that", "en"), ("le la et des", "fr"), ("el los que una", "es"), ("zzz yyy", "xx"), (None, "de"), ("no label", None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == ["de", "en", "es", "fr", "xx"] and model.families["xx"] == ["xx"]
    probe = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "123 !?", 9), (4, "der und die nicht", 9), (4, "der und die nicht", 9), (None, "the and of that " * 20_000, 9), (5, "zzz yyy", 9)], "doc_id long, text string, lang_pred int")
    found = language.identify(probe, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "lang_pred_", "score"]
    got = [(r.doc_id, r.lang_pred_) for r in found.collect()]
    assert {r.lang_pred for r in found.collect()} == {9}
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en"), (5, "xx")]
    nothing = language.identify(probe, language.learn(docs.limit(0)))
    assert {(r.lang_pred_, r.score) for r in nothing.collect()} == {("und", 0.0)}
    one = language.identify(probe, language.learn(docs.filter("lang = 'de'")))
    assert [r.lang_pred_ for r in one.collect()] == ["und"] * 3 + ["de"] * 4


def test_the_sample_is_bounded_and_stable(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    a, b = (language.learn(docs.repartition(n), sample=20) for n in (2, 5))
    assert (a.weights == b.weights).all()


def test_toxicity_of_held_out_texts(spark, larger):
    found = queries.QUERIES["op9_toxicity"](spark, larger.replace("0.01", "0.1"))
    labels = spark.read.parquet(f"{larger.replace('0.01', '0.1')}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    caught = sum(r.predicted for r in rows if r.toxic)
    assert auc > 0.95 and caught / len(bad) > 0.85 and caught / sum(r.predicted for r in rows) > 0.85
    assert all((r.score >= 0.3) == (r.predicted == 1) for r in rows)


def taught(spark):
    import random

    rng = random.Random(1)
    insults, syllables = ["scoundrel", "blockhead", "nitwit"], ["ka", "lo", "mi", "ter", "an", "es", "ro", "un"]
    rows = []
    for i in range(240):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(30)]
        if i % 2:
            words[rng.randrange(30)], words[rng.randrange(30)] = rng.sample(insults, 2)
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    return docs, labels


def test_insults_in_disguise_and_awkward_rows(spark):
    docs, labels = taught(spark)
    model = toxicity.learn(docs, labels)
    texts = ["ka blockhead", "ka b-l-o-c-k-h-e-a-d", "ka bl*ockhead", "ka blockxhead", "ka b l o c k h e a d", "BLOCKHEAD!!", "kalo mi terka", None, "", "...", "kalo " * 50_000]
    scores = model.scores(pa.array(texts, pa.string()), toxicity.Words())
    assert min(scores[:6]) > max(scores[6:])
    probe = spark.createDataFrame([(1, t, 0) for t in texts], "doc_id long, text string, toxic int")
    assert [round(r.score, 9) for r in toxicity.score(probe, model).collect()] == [round(s, 9) for s in scores]


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = taught(spark)
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        found = toxicity.score(docs, toxicity.learn(docs, few))
        assert {r.score for r in found.select(F.col("score")).collect()} == {0.0}


def test_folded_weights_equal_the_kernel():
    import numpy as np

    marks = ["trash", "clown", "weather"]
    rows = toxicity._dense(marks)
    beta = np.array([0.5, -0.2, 0.1])
    words = ["trash", "tr-ash", "whatever", "x", ""]
    assert np.allclose(toxicity._kernel_rows(words, rows) @ beta, toxicity.margins(words, (beta @ rows).astype(np.float32)), atol=1e-5)
    assert np.allclose(np.diag(toxicity._kernel_rows(marks, rows)), 1, atol=0.25)


def subsequences(word):
    """The gapped subsequences of three characters of a word and its ends, each with its weight."""
    marked, out = f"\x02{word}\x03", {}
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i < toxicity.SPAN:
            key = marked[i] + marked[j] + marked[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def test_the_kernel_equals_brute_force():
    """Hashing puts a few subsequences together; else the kernel is that of all common ones."""
    words = ["blockhead", "block-head", "nitwit", "n.i.t.w.i.t", "weather", "thehehehe", "aaaaaaaa", "ab", "é日本"]
    found = toxicity._kernel_rows(words, toxicity._dense(words))
    held = [subsequences(w) for w in words]
    for i, a in enumerate(held):
        for j, b in enumerate(held):
            size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            assert abs(found[i, j] - sum(v * b.get(k, 0) for k, v in a.items()) / size) < 0.06


def test_scores_equal_brute_force(spark):
    """Each text's score from its words, sentence by sentence."""
    import numpy as np

    docs, labels = taught(spark)
    model = toxicity.learn(docs, labels)
    texts = [r.text for r in docs.limit(30).collect()] + ["ka «blockhead»! lo", "n i t w i t", "é ü ñ ka", "ka", None, "... !!"]
    for text, score in zip(texts, model.scores(pa.array(texts, pa.string()), toxicity.Words()), strict=True):
        words, run = [], []
        for w in [*(text or "").split(), None]:
            if w is not None and len(w) == 1:
                run.append(w)
                continue
            words += [*(["".join(run)] if len(run) > 2 else []), *[x.strip(toxicity.EDGE) for x in run]]
            run = []
            words += [w.strip(toxicity.EDGE)] if w is not None else []
        worth = [float(toxicity.margins([w], model.weights)[0]) if w else 0.0 for w in words]
        margin = sorted((sum(worth[i : i + n]) / math.sqrt(n) + model.bias for n in range(1, toxicity.WIDTH + 1) for i in range(len(words) - n + 1)), reverse=True)
        x = np.array([*(margin[:3] + [toxicity.NO_SIGN] * 3)[:3], math.log1p(sum(m > 0 for m in margin)), math.log1p(len(margin))])
        z = np.append((x - model.mean) / model.spread, 1) @ model.logit
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-6


def test_languages_equal_brute_force(spark, larger):
    """Each text's vote from its trigrams, pairs and words, one by one."""
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    model = language.learn(docs, sample=30)
    rows = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["x", "12 ab 34", "É", "die the les los"]
    names, scores, _ = model.predict(pa.array(rows, pa.string()), language.Grams())
    hasher = language.tk.WordHasher()
    for text, name, score in zip(rows, names, scores, strict=True):
        data = text.lower().encode()
        folded = [c if chr(c).isalpha() or c > 127 else 32 for c in data]
        size = 32 - language.BITS
        around = [32, 32, *folded]
        grams = [(around[i + 2] | around[i + 1] << 8 | around[i] << 16) * 0x9E3779B1 % (1 << 32) >> size for i in range(len(folded))]
        pairs = [(around[i + 2] | around[i + 1] << 8) * 0x85EBCA6B % (1 << 32) >> size for i in range(len(folded))]
        words = [int(h) >> (64 - language.BITS) for _, d, o in hasher.chunks(pa.array([text.lower()])) for h in hasher.words(d, o)[0]]
        margins, square = [0.0] * len(model.pairs), 0.0
        for k, found in enumerate((grams, pairs, words)):
            for f in set(found):
                share = found.count(f) / len(found)
                square += (share * float(model.scale[(k << language.BITS) + f])) ** 2
                for p in range(len(model.pairs)):
                    margins[p] += share * float(model.weights[k, f, p])
        margins = [m / math.sqrt(square) + float(b) for m, b in zip(margins, model.biases, strict=True)]

        def duel(top, candidates, margins=margins):
            won = {x: [m if a == x else -m for (level, a, b), m in zip(model.pairs, margins, strict=True) if level == top and x in (a, b) and {a, b} <= set(candidates)] for x in candidates}
            best = max(candidates, key=lambda x: (sum(m > 0 for m in won[x]), sum(won[x])))
            return best, 1.0 if len(candidates) == 1 else 1 / (1 + math.exp(-3 * min(won[best])))

        family, sure = duel(True, sorted(model.families))
        expected, surer = duel(False, model.families[family])
        assert name == expected and abs(score - sure * surer) < 1e-4


def test_clashing_columns_pass(spark):
    docs = spark.createDataFrame([(1, "der und die", "de", 7.5, "k", 3)], "doc_id long, text string, lang string, score double, `a.b` string, fluency int")
    found = language.identify(docs, language.learn(docs), fluent=True).first()
    assert (found["score"], found["a.b"], found["fluency"], found["lang_pred"]) == (7.5, "k", 3, "de") and "score_" in found and "fluency_" in found
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).first()
    assert (scored["score"], scored["score_"], scored["a.b"]) == (7.5, 0.0, "k")
