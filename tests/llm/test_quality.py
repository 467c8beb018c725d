"""The classifier on held-out accuracy, and its edge cases."""

import random

import numpy as np
import pytest

from ringspan.llm import quality as Q


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    for i in range(n):
        w = rng.choices(words, k=rng.randint(30, 120))
        if i % 3 == 0:
            yield " ".join(x + "###" for x in w), 0
        elif i % 7 == 0:
            yield " ".join([w[0]] * len(w)), 0
        else:
            yield " ".join(w).capitalize() + ".", 1


def test_learns_held_out_rows():
    w = Q.train(list(texts(600, 1)))
    forms = {}
    rows = list(texts(300, 2))
    right = [(Q._sigmoid(Q.dot(w, t, forms)) >= 0.5) == y for t, y in rows]
    assert np.mean(right) > 0.97


def test_ftrl_step_is_the_published_one():
    m = Q.Ftrl(alpha=0.1, beta=1.0, l1=0.0, l2=1.0)
    at, x = np.array([3]), np.array([2.0])
    assert m.learn(at, x, 1) == 0.5
    g = (0.5 - 1) * 2.0
    assert m.z[3] == pytest.approx(g) and m.n[3] == pytest.approx(g * g)
    assert m.weights(at)[0] == pytest.approx(-g / ((1 + abs(g)) / 0.1 + 1))


def test_odd_rows_get_scores(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (None, 1), (6, None), (10, 0)], "doc_id long, quality int")
    w = Q.fit(odd, labels)
    rows = Q.score(odd, w).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1
    again = {r["doc_id"]: r["score"] for r in Q.score(odd.repartition(3), w).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows if r["doc_id"] is not None)


def test_no_labels_score_a_half(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.score(odd, Q.fit(odd, labels)).collect()} == {0.5}


def test_empty_table(spark, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.score(none, Q.fit(none, labels)).count() == 0


def test_held_out(spark):
    import zlib

    got = {r["i"]: r["h"] for r in spark.range(200).selectExpr("id as i").withColumn("h", Q.held_out("i")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())


def slow_places(text):
    """The hashed n-grams of each reading, word by word."""
    import zlib

    m = 2**64
    words = text.encode().split()
    h = [zlib.crc32(w) for w in words]
    form = [Q._form(w) for w in words]
    again = [sum(1 << back for back in (1, 2, 3, 4) if i >= back and h[i - back] == h[i]) for i in range(len(words))]
    pairs = lambda x: [(a * 1_000_003 % m) ^ b for a, b in zip(x, x[1:], strict=False)]
    out = []
    for salt, grams in enumerate((h, pairs(h), form, pairs(form), again, pairs(again))):
        places = []
        for g in grams:
            x = (g + salt + 1) * int(Q._P1) % m
            places.append(((x ^ (x >> 29)) * int(Q._P2) % m) >> (64 - Q.BITS))
        out.append(places)
    return out


def slow_dot(w, text):
    w = w.astype(np.float64)
    return sum(Q.SCALE * w[p] / len(places) for places in slow_places(text) for p in places) + w[-1]


def slow_train(rows, epochs=2, alpha=0.3, beta=1.0, l1=0.2, l2=1.0):
    """Follow the regularised leader, coordinate by coordinate, in plain numbers."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - l1 * (1 if zi > 0 else -1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for text, y in rows:
            x = {1 << Q.BITS: 1.0}
            for places in slow_places(text):
                for p in places:
                    x[p] = x.get(p, 0.0) + Q.SCALE / len(places)
            w = {i: weight(i) for i in x}
            p = Q._sigmoid(sum(w[i] * v for i, v in x.items()))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_and_scores_are_those_of_plain_numbers():
    rows = [*texts(40, 5), ("", 0), ("one", 1), ("ünï cödé 東京", 1)]
    w, want = Q.train(rows), slow_train(rows)
    assert all(abs(w[i] - v) < 1e-4 for i, v in want.items()) and np.count_nonzero(w) == sum(abs(v) > 0 for v in want.values())
    for t, _ in [*texts(20, 6), ("", 0), ("a b", 0)]:
        assert Q.dot(w, t, {}) == pytest.approx(slow_dot(w, t), abs=1e-6)


def test_a_text_that_does_not_fit_is_passed_over(spark):
    docs = spark.createDataFrame([(i, "good words here " * 5 if i % 2 else "bad### words###") for i in range(20)] + [(i, "long " * 5000) for i in range(100, 110)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(20), *range(100, 110), *range(5000, 5100))], "doc_id long, quality int")
    model = Q.fit(docs, labels, max_chars=5000)
    assert model.rows == 20 and any(model.weights)
    assert Q.fit(docs, labels, max_rows=25).rows == 25  # labels without a document take no place
    assert Q.fit(docs, labels).rows == 30


def test_op8_over_whole_documents(spark, tmp_path):
    import zlib

    from ringspan.llm.queries import op8_quality_classifier

    rows = list(enumerate([*(t for t, _ in texts(60, 8)), None, ""]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(60, 8))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op8_quality_classifier(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(60, 8)) if not held[i]], "doc_id long, quality int")
    w = np.frombuffer(Q.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels).weights, dtype="<f4")
    for i, t in rows:
        want = Q._sigmoid(slow_dot(w, t or ""))
        assert got[i]["held_out"] == held[i] and got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
