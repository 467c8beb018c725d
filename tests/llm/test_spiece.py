"""Encoding against the library, exact round trips, and a unigram model against enumeration."""

import itertools

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ringspan.llm import spiece as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = S.Model.load(PATH)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(text):
    words = S.marked_words(text, MODEL.word)
    got = S.encode_words(MODEL, list(set(words)))
    return [i for w in words for i in got[w]]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters=S.MARK + "\0"), max_size=40))
def test_as_the_library(text):
    assert ids(text) == SP.encode(text) and S.decode(MODEL, ids(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text("aehinorst .,-\n'", max_size=60))
def test_dense_alphabet(text):
    assert ids(text) == SP.encode(text)


def test_unigram_is_viterbi():
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.2), ("aba", -4.0)]
    m = S.Model(pieces, {}, unigram=True)
    score = {p: s for p, s in pieces[3:]}
    for n in range(1, 7):
        words = ["".join(w) for w in itertools.product("ab", repeat=n)]
        got = S.encode_words(m, words)
        for w in words:
            best = max(sum(score[p] for p in cut) for cut in cuts(w, score))
            assert abs(sum(pieces[i][1] for i in got[w]) - best) < 1e-9


def cuts(w, score):
    if not w:
        yield []
    for n in range(1, len(w) + 1):
        if w[:n] in score:
            yield from ([w[:n], *rest] for rest in cuts(w[n:], score))


def test_odd_rows(spark, odd):
    rows = S.decoded(S.encode(odd, PATH), PATH).collect()
    assert len(rows) == odd.count()
    want = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        assert r["text"] == want[r["doc_id"]]
        assert np.frombuffer(r["ids"], dtype="<u2").tolist() == SP.encode(want[r["doc_id"]])


def test_empty_table(spark, none):
    assert S.decoded(S.encode(none, PATH), PATH).count() == 0
