"""Line deduplication against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringspan.llm import blocks
from ringspan.llm import line_dedup as L
from tests.llm.cases import PASSAGE


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=25), st.text("abc ", max_size=25), st.integers(0, 25))
def test_edit_distance(a, b, most):
    d = slow_distance(a, b)
    got = L.edit_distance(a, b, most)
    assert got == d if d <= most else got > most
    assert L.similar(a, b, 0.8) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(spark, rows):
    return {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in L.dedup(docs(spark, rows)).collect()}


def test_exact_and_near_lines(spark):
    near = PASSAGE.replace("word7 ", "word9 ")
    got = result(spark, [(1, "first line of one\n" + PASSAGE), (2, "another start here\n" + PASSAGE.upper() + "!"), (3, "x\n" + near + "\nthe end of it")])
    assert got == {1: ("first line of one\n" + PASSAGE, []), 2: ("another start here", [1]), 3: ("x\nthe end of it", [1])}


def test_short_lines_and_repeats_inside(spark):
    line = "this line has six words here"
    got = result(spark, [(5, f"yes\n{line}\nyes\n{line}\n"), (4, f"yes\n{line}")])
    assert got == {4: (f"yes\n{line}", []), 5: ("yes\nyes\n", [1, 3])}


def test_distinct_lines_stay(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(4))) for i in range(50)]
    assert result(spark, rows) == {i: (t, []) for i, t in rows}


def test_same_words_in_another_order_stay(spark):
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcd"]
    a, b, c = " ".join(words), " ".join(words[::-1]), " ".join(words[::-1]) + "x"
    got = result(spark, [(1, a), (2, b), (3, c)])
    assert got[1][1] == [] and got[2][1] == [] and got[3][1] == [0]


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_rows(spark, odd, parts):
    rows = L.dedup(odd.repartition(parts)).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == " \t\n "
    assert got[7]["dropped_lines"] == [0] and got[6]["dropped_lines"] == [] and got[2]["dropped_lines"] == [1]


def test_empty_table(spark, none):
    assert L.dedup(none).count() == 0


def test_failed_links_do_not_part_lines(spark, monkeypatch):
    """Lines of one SimHash, most of them unlike: the alike ones must meet all the same."""
    monkeypatch.setattr(L, "prints", lambda hashes, n, width: __import__("numpy").zeros((len(n), width), dtype="uint64"))
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    bases = [[word() for _ in range(14)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)] + [(100 + i, " ".join([*b[:-1], word()])) for i, b in enumerate(bases)]
    got = result(spark, rows)
    assert {i: d for i, (_, d) in got.items()} == {i: [0] if i >= 100 else [] for i, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_permuted_lines_and_one_near_copy(spark, seed):
    """All have one bag of words and so one SimHash; only two are alike."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(words, len(words)))) for i in range(20)]
    near = rows[7][1].split(" ")
    near[11], near[12] = near[12], near[11]
    got = result(spark, [*rows, (90, " ".join(near))])
    assert {i for i, (_, d) in got.items() if d} == {90}


def slow_groups(norms):
    """Least member of each line's group, over all pairs."""
    root = list(range(len(norms)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(norms)):
        for j in range(i):
            if L.similar(norms[i], norms[j], 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(norms))]


def near_lines(seed, bases, copies):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmn", k=rng.randint(2, 9))) for _ in range(400)]
    out = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        for _ in range(copies):
            line = list(base)
            line[rng.randrange(len(line))] = rng.choice(words)
            out.append(" ".join(line))
    return out


@pytest.mark.parametrize(("seed", "bases", "copies"), [(1, 60, 5), (2, 3, 100)])
def test_groups_are_those_of_all_pairs(spark, seed, bases, copies):
    lines = near_lines(seed, bases, copies)
    got = result(spark, list(enumerate(lines)))
    want = slow_groups([L.normalised(x) for x in lines])
    assert {i for i, (_, d) in got.items() if not d} == set(want)


def test_equal_lines_go_whatever_their_number(spark):
    line = "one line that very many documents share with others"
    got = spark.range(3000).selectExpr("id as doc_id", f"concat('{line}\n', id, ' is a number') as text")
    assert L.dedup(got).where("size(dropped_lines) = 0").count() == 1


def test_names_of_its_own_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6)], "doc_id long, text string, id int, thash int, Dropped_Lines int")
    got = L.dedup(rows.withColumnRenamed("Dropped_Lines", "_id")).orderBy("doc_id").collect()
    assert [r["dropped_lines"] for r in got] == [[], [0]] and [r["_id"] for r in got] == [3, 6]


def test_no_filter_beyond_its_size(spark, monkeypatch):
    rows = [(1, PASSAGE), (2, PASSAGE.replace("word7 ", "word9 "))]
    want = result(spark, rows)
    monkeypatch.setattr(L, "FILTER_LINES", 0)
    assert result(spark, rows) == want and want[2][1] == [0]


def test_prints_are_majorities_of_distinct_words():
    rng = np.random.default_rng(4)
    n = np.array([1, 2, 5, 5, 300, 0, 7])
    h = rng.integers(0, 40, n.sum(), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got, at = L.prints(h, n, 3), 0
    for k, p in zip(n, got, strict=True):
        words = np.unique(h[at : at + k])
        bits = L.bits_of(words, 3).sum(axis=0, dtype=int)
        assert (np.unpackbits(p.view(np.uint8), bitorder="little") == (2 * bits > len(words))).all()
        at += k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB1 \t\n!é🙂\r", max_size=30), min_size=1, max_size=5))
def test_lines_normalised_together(texts):
    got = L._Lines([t.encode() for t in texts])
    want = [(i, k, L.normalised(x)) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    assert list(zip(got.of.tolist(), got.at.tolist(), [x.decode() for x in got.norms], strict=True)) == want
    assert got.words.tolist() == [len(x.split()) for _, _, x in want] and got.sizes().tolist() == [len(x) for _, _, x in want]
    words = [w for _, _, x in want for w in x.split()]
    h = got.hashes().tolist()
    assert len(h) == len(words) and len(set(h)) == len(set(words)) == len(set(zip(h, words, strict=True)))


def test_forests_are_least_and_leave_marks():
    last = np.array([0, 1, 3, 7, 0xFF, 0xFE], dtype=np.uint64)
    u, v = np.array([0, 0, 0, 1, 1, 2, 4]), np.array([1, 2, 3, 2, 3, 3, 5])
    a, b, more = blocks.forest(u, v, last, np.arange(6))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (1, 2), (2, 3), (4, 5)]
    assert more.tolist() == [True] * 4 + [False] * 2


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "dddd", "e"]), min_size=1, max_size=14), st.lists(st.sampled_from(["a", "bb", "ccc", "dddd", "e", "x"]), min_size=1, max_size=14), st.integers(0, 30))
def test_word_by_word_is_an_upper_bound(x, y, most):
    if L._word_by_word(x, y, most):
        assert slow_distance(" ".join(x), " ".join(y)) <= most
    assert L._word_by_word(x, x, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé 𝄞", max_size=150), st.text("abé 𝄞", max_size=150)), min_size=1, max_size=6))
def test_edit_distances_side_by_side(pairs):
    a, b = zip(*pairs, strict=True)
    assert L.edit_distances(a, b).tolist() == [slow_distance(x, y) for x, y in pairs]
    assert L._similar(list(a), list(b), 0.8).tolist() == [slow_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in pairs]


def test_pairs_of_lines_are_measured_together(monkeypatch):
    rng = random.Random(6)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    a = [line(rng.choice([63, 64, 65, 400, 1000])) for _ in range(300)] + [line(9000)] * 2 + [line(33000)]
    b = ["".join(c if rng.random() > 0.15 else rng.choice("abc") for c in x) if i % 2 else line(len(x)) for i, x in enumerate(a)]
    want = [L.edit_distance(x, y, int(0.2 * len(x) + 1e-9)) <= int(0.2 * len(x) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert True in want and False in want
    alone = []
    monkeypatch.setattr(L, "edit_distance", lambda x, y, most, f=L.edit_distance: alone.append(x) or f(x, y, most))
    assert L._similar(a, b, 0.8).tolist() == want
    assert len(alone) < 20
