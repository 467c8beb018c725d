"""Packing against the tokenizer itself and the rules of a packing."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ringspan.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    tok = Tokenizer.from_file(PATH)
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_as_whole_texts_do():
    texts = ["It's ONE thing: Ärger", "<|endoftext|>", "a <|endoftext|> b<|STARTOFTEXT|>", "<|startoftext|>x", "ΣΑΣ ΟΔΟΣ", "é", "\x1c\x1fa\x85b", "İstanbul I'll 'LL ''s", "½²x ª×÷", "東京 x", "", "  ", "a" * 3000]
    got = P._encoder(PATH)(texts)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == ids_of(texts)


def test_each_character_of_the_word_pattern_encodes_as_the_tokenizer_does():
    alone = [chr(c) for c in range(0x250)]
    inside = [f"ab{c}cd{c}{c} x{c}" for c in alone]
    rng = random.Random(5)
    odd = "".join(alone) + "\u212a\u212b\u1e9e\u0307 's'll"
    strings = ["".join(rng.choices(odd, k=rng.randint(1, 30))) for _ in range(10_000)]
    texts = ["\u0189c", "Azərbaycan DİLİ \u018fLİ", *alone, *inside, *strings]
    got = P._encoder(PATH)(texts)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == ids_of(texts)


def check(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_pack_odd_rows(spark, odd):
    rows = P.pack(odd, PATH).collect()
    check(rows, 2048)
    want = ids_of([r["text"] or "" for r in odd.collect()])
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in want)
    whole = [r for r in rows if r["doc_id"] == 4]
    assert [(r["piece"], r["length"], bytes(r["ids"])) for r in whole] == [(0, 1, b"\0\0\0\0")]
    long = sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["piece"])
    assert [r["start"] for r in long] == [2048 * k for k in range(len(long))] and len(long) > 1


def test_empty_table(spark, none):
    assert P.pack(none, PATH).count() == 0


def test_best_fit_prefers_the_tightest():
    f = P.BestFit(10, 4)
    assert f.add(6) == (0, 0) and f.add(7) == (1, 0)
    assert f.add(3) == (1, 7)  # fits both; three free places are tighter than four
    assert f.add(4) == (0, 6)


def test_fullest_closes_first():
    f = P.BestFit(10, 1)
    f.add(4)
    f.add(7)  # two open: the one with three free places closes
    assert f.add(3)[0] == 0


def test_the_cache_turns_over(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 40)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(30)) for _ in range(40)]
    encode = P._encoder.__wrapped__(PATH)
    got = [x for k in range(0, 40, 3) for x in encode(texts[k : k + 3])]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == ids_of(texts)


def test_another_vocabulary_encodes_whole_texts():
    made = Tokenizer.from_file(PATH)
    assert P._splits_into_words(made)
    from tokenizers.normalizers import NFC

    made.normalizer = NFC()
    assert not P._splits_into_words(made)


def placed(spark, lengths, packers=1, **kw):
    rows = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "seat long, piece int, length long")
    got = P.place(rows, packers, **kw).collect()
    assert sorted((r["seat"], r["length"]) for r in got) == list(enumerate(lengths))
    return got


def test_near_the_bound(spark):
    rng = random.Random(1)
    lengths = [rng.choice([rng.randint(1, 600), rng.randint(1, 2048), 2048]) for _ in range(20000)]
    got = placed(spark, lengths)
    check([r.asDict() for r in got], 2048)
    assert len({r["sequence_id"] for r in got}) <= 1.002 * sum(lengths) / 2048 + 1


def test_the_bound_holds():
    """No more than open_bins sequences are ever open, and a tight bound costs sequences."""
    rng = random.Random(5)
    lengths, made = [rng.randint(1, 2048) for _ in range(4000)], []
    for open_bins in (1, 8, 512):
        f = P.BestFit(2048, open_bins)
        for n in lengths:
            f.add(n)
            assert f.open <= open_bins and f.open == sum(map(len, f.free.values())) and f.bits == sum(1 << k for k in f.free)
        made.append(f.next_id)
    assert made[0] > made[1] >= made[2]


def test_places_do_not_depend_on_batches(spark):
    lengths = [(k * 7919) % 2048 + 1 for k in range(3000)]
    want = placed(spark, lengths, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        assert sorted(placed(spark, lengths, 3)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_repeated_ids_share_the_packers(spark):
    """Rows of one id, or of none, with one text: no packer takes them all."""
    docs = spark.createDataFrame([(None, "same text")] * 1000 + [(7, "same text")] * 1000, "doc_id long, text string")
    pieces = P.tokenize_pieces(docs, PATH)
    got = P.place(pieces.drop("ids"), 8).collect()
    packers = [r["sequence_id"] >> 40 for r in got]
    assert len(got) == 2000 and max(map(packers.count, set(packers))) < 500


def test_op1_over_whole_documents(spark, tmp_path):
    """The query's columns against the tokenizer and the rules of its contract."""
    from zlib import crc32

    from ringspan.llm.queries import op1_best_fit_packing

    texts = {1: "Some words <|endoftext|> more", 2: None, 3: "long text " * 3000, 4: "Ärger 東京"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op1_best_fit_packing(spark, str(tmp_path)).collect()
    check(rows, 2048)
    for i, text in texts.items():
        ids = [*ids_of([text or ""])[0], 0]
        want = [(k // 2048, k, len(ids[k : k + 2048]), crc32(np.array(ids[k : k + 2048], dtype="<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i) == want
