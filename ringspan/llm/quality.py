"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text becomes word n-grams of three readings: the words themselves, their forms (letter case,
trailing marks) and whether a word repeats one just before; each is hashed into a table of weights
and counted by its share of the text. Training runs the FTRL-proximal update over a bounded sample
of labelled rows in a fixed order, inside one executor task; scoring is a narrow map that takes
the sparse dot product of each text's n-grams with the weights.

Scale: the sample is at most `max_rows` labelled rows that have a document, chosen by a hash of the id so
that it does not depend on the partitioning, and of at most `max_chars` characters together: a text that
does not fit into what is left of them is passed over. The model says how many rows it learnt from. The
weights are of a fixed size. Scoring reads each text once, whole, with no shuffle.

Cases: a null text is empty and scores by the bias alone; null labels and null ids are not learnt
from; rows with equal ids learn from each label; no labelled rows give a score of 0.5; an empty
table gives no rows; other columns stay.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.llm._shared import ship

#: The number of weights is a power of two; one more is the bias.
BITS = 18
#: What an n-gram that fills its reading counts.
SCALE = 8.0
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _form(w: bytes) -> int:
    """A small number for the look of a word: letter case, length class, and the mark it ends in."""
    body = w.rstrip(b"!?#*$%&|<>.,;:()[]{}\"'=+-_/\\~^`@")
    tail = w[len(body) :]
    case = 0 if not body else 1 if body.islower() else 2 if body.isupper() and len(body) > 1 else 3 if body[:1].isupper() else 4 if body.isdigit() else 5
    return case * 4096 + min(len(body), 15) // 4 * 1024 + (tail[-1] if tail else 0) * 4 + min(len(tail), 3)


def hashed(text: str, forms: dict[bytes, int]) -> list[np.ndarray]:
    """The places of a text's n-grams, an array for each reading and n."""
    from zlib import crc32

    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return []
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=n)
    new = [w for w in set(words) if w not in forms]
    if len(forms) + len(new) > 300_000:
        forms.clear()
        new = list(set(words))
    forms.update((w, _form(w)) for w in new)
    f = np.fromiter(map(forms.__getitem__, words), dtype=np.uint64, count=n)
    again = np.zeros(n, dtype=np.uint64)
    for back in (1, 2, 3, 4):
        if n > back:
            again[back:] |= (h[back:] == h[:-back]).astype(np.uint64) << np.uint64(back)
    out = []
    for salt, grams in enumerate((h, _pairs(h), f, _pairs(f), again, _pairs(again))):
        if len(grams):
            x = (grams + np.uint64(salt + 1)) * _P1
            x ^= x >> np.uint64(29)
            out.append(((x * _P2) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def dot(weights: np.ndarray, text: str, forms: dict[bytes, int]) -> float:
    """The sparse dot product of a text's n-grams, each counting SCALE by its share, and the bias."""
    return SCALE * sum(float(weights[x].mean(dtype=np.float64)) for x in hashed(text, forms)) + float(weights[-1])


def _pairs(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * np.uint64(1_000_003)) ^ h[1:]


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """FTRL-proximal logistic regression over 2**BITS hashed weights and a bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.2, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> float:
        """One update with a row of distinct places; the loss before it."""
        w = self.weights(at)
        p = _sigmoid(float(w @ x))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def _row(text: str, forms: dict) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's n-grams, each place once, and of the bias."""
    grams = hashed(text, forms)
    if not grams:
        return np.array([1 << BITS], dtype=np.int32), np.ones(1, dtype=np.float32)
    at, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    x = np.bincount(inverse, weights=np.concatenate([np.full(len(g), SCALE / len(g)) for g in grams]))
    return np.append(at, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32)


def train(rows, epochs: int = 2, **kw) -> np.ndarray:
    """The weights learnt from (text, label) rows, in their order, epochs times."""
    model, forms = Ftrl(**kw), {}
    held = [(*_row(t, forms), y) for t, y in rows]
    for _ in range(epochs):
        for at, x, y in held:
            model.learn(at, x, y)
    return model.weights(np.arange((1 << BITS) + 1)).astype(np.float32)


class Model(NamedTuple):
    """Weights as little-endian float32, and how many rows they were learnt from."""

    weights: bytes
    rows: int


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8_000, max_chars: int = 60_000_000) -> Model:
    """A model learnt from at most max_rows rows that have a label and a document: those with the least
    hashes of their id. max_chars bounds what one task holds: a text that does not fit any more is passed
    over, shorter ones after it are not. labels: (id, label), already held-out."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    least = known.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(5)), "id", "y").limit(max_rows)
    rows = least.join(texts, "id")
    order = rows.select("t", "y", F.xxhash64("id", F.lit(5)).alias("h"), "id").repartition(1).sortWithinPartitions("h", "id", "y", F.xxhash64("t"))

    def run(batches):
        learnt = 0

        def each():
            nonlocal learnt
            chars = 0
            for b in batches:
                for t, y in zip(b.column(0), b.column(1), strict=True):
                    text = t.as_py()
                    if chars + len(text) <= max_chars:
                        chars += len(text)
                        learnt += 1
                        yield text, y.as_py()

        w = train(each())
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([learnt], pa.int64())], names=["w", "n"])

    found = order.mapInArrow(run, "w binary, n long").first()
    return Model(bytes(found["w"]), found["n"]) if found else Model(bytes(4 * ((1 << BITS) + 1)), 0)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1, in `out` (in place of a column of that name)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model.weights)
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    src = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    at = src.columns.index(text_col)

    def run(batches):
        w = np.frombuffer(sent.value, dtype="<f4")
        forms: dict = {}
        for b in batches:
            s = [_sigmoid(dot(w, t.as_py() or "", forms)) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)


def held_out(id_col):
    """Whether a row is kept from training: the CRC-32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0
