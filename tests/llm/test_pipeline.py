"""The pipeline against its stages' duties, on a small corpus."""

import random

import corpus_pipeline as C
from tests.llm.cases import PASSAGE


def corpus(spark, path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(300):
        w = rng.choices(words, k=rng.randint(40, 120))
        junk = i % 5 == 0
        text = " ".join(x + "###" for x in w) if junk else " ".join(w).capitalize() + "."
        if i % 50 == 7:
            text += "\n" + PASSAGE
        if i % 50 == 9:
            text += "\npassword=b7db7aa4a5fcc78305"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not junk), 0))
    rows.append((1000, rows[1][1], "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES[:-1]:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == C.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in range(300) if i % 5}
    assert set(kept["quality_classifier"]) == clean | {1000}
    lines = kept["line_dedup"]
    assert sum(PASSAGE in t for t in lines.values()) == 1 and lines[1000] == ""
    assert set(kept["simhash_near_dedup"]) >= clean
    assert all("b7db7aa4a5fcc78305" not in t for t in kept["secret_scan"].values())
    assert any("[SECRET]" in t for t in kept["secret_scan"].values())
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept["secret_scan"])


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    corpus(spark, tmp_path)
    rows = C.run(spark, str(tmp_path)).collect()
    assert all(r["offset"] + r["length"] <= 2048 for r in rows) and rows


def test_near_copies_from_similarity_08_go(spark):
    """Planted copies at a Jaccard similarity of 0.8 to 0.9, one below, and repeated rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, gone = [], set()
    for i in range(20):
        w = [word() for _ in range(200)]
        rows.append((i, " ".join(w)))
        for k in range(2 if i < 15 else 8):
            w[20 * k + 10] = word()
        rows.append((100 + i, " ".join(w)))
        a, b = grams(rows[-2][1]), grams(rows[-1][1])
        near = len(a & b) / len(a | b)
        assert 0.8 <= near < 0.91 if i < 15 else near < 0.8
        gone |= {100 + i} if i < 15 else set()
    rows += [(0, rows[0][1]), (None, "no id but five words here"), (None, "no id but five words here"), (0, "other text of the same id as one above")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted({(i, t) for i, t in rows if i not in gone}, key=str)


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    spark.createDataFrame([(1, 1), (8, 0), (None, 1), (4, None), (7, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {}
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == C.COLUMNS
        rows[name] = got.collect()
    assert len(rows["line_dedup"]) == len(rows["secret_scan"]) == odd.count() >= len(rows["quality_classifier"])
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in rows["line_dedup"] + rows["secret_scan"])
    assert next(r for r in rows["secret_scan"] if r["doc_id"] == 3)["text"] is None
    near = [r["doc_id"] for r in rows["simhash_near_dedup"]]
    # 2 is there twice; 4 and 5 are as empty as 3; 7 is a copy of 6
    assert sorted(near, key=str) == sorted([1, 2, 3, None, 6, 8, 9, 10, 11, -5], key=str)
    packed = C.STAGES[-1][1](spark, odd, str(tmp_path)).collect()
    assert len({r["sequence_id"] for r in packed}) < len(packed) and {r["doc_id"] for r in packed} == {r["doc_id"] for r in odd.collect()}


def test_empty_table_through_all_stages(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for _, stage in C.STAGES)


def test_one_row_of_each_group_stays(spark):
    """Equal texts under equal, other and no ids; one id with two texts."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (None, b), (None, "a text that has no id at all")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "a text that has no id at all")], key=str)
