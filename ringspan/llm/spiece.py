"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are cut into marked words (the mark and what follows up to the next mark), which no piece of
the vocabulary spans. The distinct marked words of a batch are sorted, which is a trie in depth-
first order: what two neighbours share is walked once, its forward states are kept on a stack and
reused. A forward state is the last piece of the best segmentation of a prefix, as in Viterbi.

The vocabulary at hand is of the merging (BPE) kind, whose encoding is not the path of the largest
score sum. The pass is exact for it all the same: the encoding of a prefix of an encoding is its
first pieces, so the state at a place is the one piece that ends there and agrees with the piece
before it. Two neighbours agree if merging their characters gives back just those two. For a
unigram vocabulary the state is the piece with the best score sum.

Scale: a narrow map. Forward results of words seen before are kept in a bounded cache.

Cases: a null text is empty and gives no ids; characters outside the vocabulary become byte
pieces; white space is kept as it is, and decoding gives the text back (texts that hold the mark
itself, which reads as a space, are the one exception); equal rows are encoded each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.llm._shared import ship

MARK = "▁"
#: Marked words whose ids a worker keeps at most.
CACHE_WORDS = 350_000


_LETTER = re.compile("[A-Za-zÀ-ÿ]")
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Model:
    """A vocabulary with scores, its byte pieces, and what merging two symbols gives."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_at: dict[int, int], unigram: bool = False):
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        self.names = [p for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.bytes_at, self.byte_of = bytes_at, {i: b for b, i in bytes_at.items()}
        self.unigram = unigram
        special = set(bytes_at.values()) | {0, 1, 2}
        self.merge = {p: (self.scores[i], i) for p, i in self.ids.items() if i not in special}
        self.longest = max(map(len, self.merge), default=1)
        ends: dict[str, set[int]] = {}
        for p in self.merge:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: How long the pieces are that end in two letters, the shortest first.
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}
        self.agree: dict[tuple[str, str], bool] = {}
        # a word of letters parts from a sign that no piece has after such a letter: nothing is lost
        after = {b for p in self.merge for a, b in zip(p, p[1:]) if _LETTER.match(a)}
        signs = "".join(re.escape(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_{|}~\n" if c not in after)
        self.word = re.compile(f"{MARK}*{_LETTER.pattern}+(?=[{MARK}{signs}]|$)|{MARK}+[^{MARK}]*|[^{MARK}]+") if signs else _WORD

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], at)

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges: the best score first, the leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                m = self.merge.get(symbols[i] + symbols[i + 1])
                if m and (best is None or m[0] > best):
                    best, at = m[0], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def neighbours(self, a: str, b: str) -> bool:
        """Whether a and b, merged from their characters, stay those two pieces; a may be empty."""
        got = self.agree.get((a, b))
        if got is None:
            if len(self.agree) > 400_000:
                self.agree.clear()
            got = self.agree[a, b] = self.merged(list(a + b)) == ([a, b] if a else [b])
        return got


def _forward(model: Model, word: str, last: list[str], total: list[float], shared: int) -> None:
    """Extend the states of a word's prefixes beyond the shared ones: last[i] ends prefix i."""
    merge, longest = model.merge, model.longest
    del last[shared + 1 :]
    del total[shared + 1 :]
    if model.unigram:
        for i in range(shared + 1, len(word) + 1):
            best, piece = -1e18, word[i - 1]
            for j in range(max(0, i - longest), i):
                m = merge.get(word[j:i])
                s = total[j] + (m[0] if m else -1e6 if j == i - 1 else -1e18)
                if s > best:
                    best, piece = s, word[j:i]
            last.append(piece)
            total.append(best)
        return
    agree, ends = model.agree, model.ends
    for i in range(shared + 1, len(word) + 1):
        piece = word[i - 1]  # the one that agrees is unique, and most often short
        for n in (1, *ends.get(word[i - 2 : i], ())):
            if n > i:
                continue
            piece = word[i - n : i]
            if n > 1 and piece not in merge:
                continue
            before = last[i - n]
            ok = agree.get((before, piece))
            if ok or ok is None and model.neighbours(before, piece):
                break
        last.append(piece)


def encode_words(model: Model, words: list[str]) -> dict[str, list[int]]:
    """The ids of each word, by one depth-first walk over the trie of all of them."""
    out: dict[str, list[int]] = {}
    last, total, before = [""], [0.0], ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(word, before):
            if a != b:
                break
            shared += 1
        _forward(model, word, last, total, shared)
        before, at, pieces = word, len(word), []
        while at:
            pieces.append(last[at])
            at -= len(last[at])
        ids: list[int] = []
        for p in reversed(pieces):
            i = model.merge.get(p)
            ids += [i[1]] if i else [model.bytes_at.get(x, 0) for x in p.encode("utf-8", "replace")]
        out[word] = ids
    return out


def marked_words(text: str, word: re.Pattern = _WORD) -> list[str]:
    """The marked words of a text; a model's own pattern parts some further."""
    return word.findall(MARK + text.replace(" ", MARK)) if text else []


def decode(model: Model, ids) -> str:
    """The text of ids: pieces and runs of byte pieces joined, marks as spaces, less the first."""
    out = bytearray()
    for i in ids:
        b = model.byte_of.get(int(i))
        if b is not None:
            out.append(b)
        elif int(i) > 2:
            out += model.names[int(i)].encode()
    text = out.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _loaded(path: str):
    return Model.load(path), {}


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids are little-endian unsigned 16-bit integers if the vocabulary has fewer than
    65,536 pieces (ids_width 2), else 32-bit ones (ids_width 4)."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = T.StructType([src.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("ids_width", T.IntegerType())])

    def run(batches):
        model, cache = _loaded(model_path)
        width = 2 if len(model.names) < 65536 else 4
        kind = "<u2" if width == 2 else "<u4"
        for b in batches:
            for k in range(0, b.num_rows, 500):
                words = [marked_words(t.as_py(), model.word) for t in b.column(1).slice(k, 500)]
                seen = set().union(*words)
                new = [w for w in seen if w not in cache]
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = list(seen)
                cache.update((w, np.array(i, dtype=kind).tobytes()) for w, i in encode_words(model, new).items())
                ids = [b"".join(map(cache.__getitem__, w)) for w in words]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 500), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())], names=out.names)

    return src.mapInArrow(run, out)


def decoded(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, ids_width, text): the text of each row's ids."""
    ship(encoded.sparkSession)
    src = encoded.select(id_col, "ids", "ids_width")
    out = T.StructType([*src.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        model = _loaded(model_path)[0]
        names = [n.encode() for n in model.names]
        for i, b in model.byte_of.items():
            names[i] = bytes([b])
        for i in (0, 1, 2):
            names[i] = b""
        for b in batches:
            texts = []
            for ids, width in zip(b.column(1), b.column(2), strict=True):
                got = np.frombuffer(ids.as_py(), dtype="<u2" if width.as_py() == 2 else "<u4").tolist()
                text = b"".join(map(names.__getitem__, got)).decode("utf-8", "replace").replace(MARK, " ")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=out.names)

    return src.mapInArrow(run, out)
