import random
import zlib

import numpy as np

from voxlake.llm import toxicity


def make(n, seed=1):
    rnd = random.Random(seed)
    words = [f"{rnd.choice('bcdfgh')}{rnd.choice('aeiou')}{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.choice([5, 30, 200]))
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "moron", "loweisp" + rnd.choice("abcdef")]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_terms_are_words_and_their_beginnings():
    assert toxicity.terms("").tolist() == []
    assert len(toxicity.terms("Ab ab AB 1 2")) == 1
    assert len(toxicity.terms("abcdef")) == 3
    assert set(toxicity.terms("abcdefg")) & set(toxicity.terms("abcdexyz"))


def test_factors_learn_a_pair_that_no_single_word_shows():
    a, b, c, d = (np.array([k]) for k in (3, 5, 8, 13))
    pairs = [(a, c, 1), (b, d, 1), (a, d, 0), (b, c, 0)] * 200
    rows = [np.sort(np.concatenate((x, y))) for x, y, _ in pairs]
    y = np.array([t for *_, t in pairs], float)
    fm = toxicity.fit(rows, y, np.ones(len(y)))
    p = fm.score(rows[:4])
    assert p[0] > 0.7 and p[1] > 0.7 and p[2] < 0.3 and p[3] < 0.3


def pair_texts(n, share, seed, words=30):
    """(docs, labels, those with a pair): the label is 1 where the two words of a pair agree; each word alone tells as little as the pair's being there."""
    rnd = random.Random(seed)
    voc = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(1500)]
    weight = [1 / (k + 5) for k in range(len(voc))]
    docs, labels, paired = [], [], set()
    for i in range(n):
        w, toxic = rnd.choices(voc, weight, k=words), 0
        if rnd.random() < share:
            a, b = rnd.randrange(2), rnd.randrange(2)
            w[rnd.randrange(words // 2)], w[words // 2 + rnd.randrange(words // 2)] = ("xalpha", "ybravo")[a], ("zdelta", "qgamma")[b]
            toxic = int(a == b)
            paired.add(i)
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels, paired


def area(truth, score):
    pos, neg = score[truth == 1], score[truth == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def test_training_learns_pairs_in_texts_of_thirty_words(spark):
    docs, labels, paired = pair_texts(8000, 0.16, 1)  # 6,000 of them to learn from
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = [(t, y) for (i, t), (_, y) in zip(docs, labels) if i in paired and zlib.crc32(str(i).encode()) % 4 == 2]
    rows, truth = [toxicity.terms(t) for t, _ in out], np.array([y for _, y in out])
    assert area(truth, model.score(rows)) > 0.9
    model.v[:] = 0
    assert area(truth, model.score(rows)) < 0.65  # the words alone don't tell


def test_held_out_accuracy_and_contract(spark):
    docs, labels = make(1500)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(d, lab)
    rows = toxicity.scored(d, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted").collect()
    truth = dict(labels)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    again = toxicity.train(d.repartition(3), lab)
    assert np.array_equal(model.w, again.w) and np.array_equal(model.v, again.v)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = make(200)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (toxicity.train(d, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.w, b.w) and a.bias == b.bias


def test_corner_cases(spark):
    docs, labels = make(60)
    odd = [(900, None, "s"), (901, "", "s"), (902, "idiot " * 30_000, "s"), (None, "moron", "s"), (5, docs[5][1], "s"), (903, "日本 é %%% 12", "s")]
    d = spark.createDataFrame(docs + odd, "doc_id bigint, text string, predicted string")
    lab = spark.createDataFrame(labels + [(3, 1), (3, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() <= d.count()
    model = toxicity.train(d, lab.filter("false"))
    assert [r.score for r in toxicity.scored(d, model).collect()] == [0.5] * d.count()
    assert toxicity.scored(d.filter("false"), model).count() == 0


def test_forward_equals_a_plain_sum_over_pairs():
    """Every pair of a text's terms by itself: b + sum w x + sum over i < j of <v_i, v_j> z z."""
    rng = np.random.default_rng(3)
    kept = np.sort(rng.choice(toxicity.BUCKETS, 40, replace=False))
    fm = toxicity.FactorizationMachine(-0.7, kept, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    rows = [np.sort(rng.choice(kept, n, replace=False)) for n in (0, 1, 2, 7, 40)] + [np.array([1, 2, 3])]
    got = fm.score(rows)
    for r, p in zip(rows, got):
        at = [int(np.flatnonzero(kept == t)[0]) for t in r if t in kept]
        z = 1 / max(1, len(at)) ** 0.5
        logit = fm.bias + sum(fm.w[i] for i in at)
        for a in range(len(at)):
            for b in range(a):
                logit += float(fm.v[at[a]] @ fm.v[at[b]]) * z * z
        assert abs(p - 1 / (1 + np.exp(-logit))) < 1e-9
