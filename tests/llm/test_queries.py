"""The registered queries that have no test beside their operator's: their columns against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import public_tokenizers

from ringspan.llm import ann, line_dedup, queries
from tests.llm.cases import ODD, PASSAGE
from tests.llm.test_line_dedup import near_lines, slow_groups
from tests.llm.test_simhash import slow_print, slow_roots


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op4_on_one_window(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((28, 7)).astype(np.float32)
    rows = [(50 * i if i < 5 else 1000 + i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (450, [0.0] * 7), (401, [float("nan")] * 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in queries.op4_hilbert_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    w = v.astype(float)
    assert set(got) == {i for i, _ in rows[:28] if i % 50 == 0}
    for q, (i, _) in enumerate(rows[:28]):
        if i in got:
            s = sorted((-float(ann.exact(w[q : q + 1], w[j : j + 1])[0]), rows[j][0]) for j in range(28) if j != q)[:5]
            assert got[i] == {k: (x, -c) for k, (c, x) in enumerate(s, 1)}


def test_op5_against_the_library(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {i: t for i, (_, t, *_) in enumerate(ODD)}
    rows = {r["doc_id"]: r for r in queries.op5_sentencepiece(spark, write(spark, tmp_path, list(texts.items()))).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        ids = sp.encode(t or "")
        data = np.array(ids, dtype="<u4").tobytes()
        assert rows[i]["n_ids"] == len(ids), i
        if rows[i]["ids_crc32"] != crc32(data):  # ids may be held in two bytes
            assert rows[i]["ids_crc32"] == crc32(np.array(ids, dtype="<u2").tobytes())
        assert rows[i]["text_md5"] == hashlib.md5(sp.decode(ids).encode()).hexdigest()


def test_op6_against_all_pairs(spark, tmp_path):
    rng = random.Random(2)
    texts = [t for _, t, *_ in ODD]
    for _ in range(12):
        base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(base).upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    got = queries.op6_simhash(spark, write(spark, tmp_path, rows)).collect()
    prints = {i: slow_print(t) for i, t in rows}
    assert len(got) == len(rows) and all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in got)
    root = slow_roots(sorted(set(prints.values())))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[i]]] = min(i, least.get(root[prints[i]], i))
    assert all(r["component_id"] == least[root[prints[r["doc_id"]]]] for r in got)


def test_op9_against_all_pairs(spark, tmp_path):
    rng = random.Random(6)
    lines = near_lines(9, 15, 4) + [PASSAGE, "short line"]
    texts = {i: "\n".join(rng.sample(lines, 5)) for i in range(40)} | {90: None, 91: "", 92: PASSAGE.upper()}
    got = {r["doc_id"]: r for r in queries.op9_line_dedup(spark, write(spark, tmp_path, list(texts.items()))).collect()}
    norms = [line_dedup.normalised(x) for x in lines]
    group = dict(zip(norms, slow_groups(norms), strict=True))
    seen = set()
    for i in sorted(texts):
        dropped = []
        for k, x in enumerate((texts[i] or "").split("\n")):
            n = line_dedup.normalised(x)
            if len(n.split()) >= 5:
                if group[n] in seen:
                    dropped.append(k)
                seen.add(group[n])
        assert got[i]["dropped_lines"] == ",".join(map(str, dropped)) and got[i]["n_dropped"] == len(dropped)
        keep = [x for k, x in enumerate((texts[i] or "").split("\n")) if k not in dropped]
        assert got[i]["text"] == (None if texts[i] is None else "\n".join(keep))
