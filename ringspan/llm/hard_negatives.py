"""Hard negatives by inner product, over a table of pivot distances.

Vectors are integers. A row x gets one more component, sqrt(M - |x|^2) for the largest squared norm M of all
rows, and a query q gets a zero: then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest rows are those of
the largest inner product. `pivots` rows are chosen far from each other, and the distance of every row to each
is stored. For a query the triangle inequality gives |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), and with
it a bracket of the score of each row; only rows whose bracket can hold a wanted score are scored, exactly, in
integers.

`mine` runs two searches. The first gives an anchor's positives: its best rows of the same label. The second
gives, for each positive, the best rows of other labels whose score lies between `low` and `high` percent of
the positive's.

Scale: anchors are dealt to blocks of about `block_anchors` and rows to parts; a cell is one block and one part, and a
task holds a block's vectors and its best rows so far while the part's rows stream past. The first search
deals by label, in as many blocks as a label's anchors take, so a hot label is many cells; the second sends every
row to every block of anchors. Cells give a few rows an anchor, which merge by window. Of equal vectors of one
label only the first few ids can be among the first few answers; the others leave the index, exactly. Pivots and M
are all that is broadcast. Pivots are chosen from at most `sample_rows` rows and `sample_bytes` bytes; the bound
changes how much is scored, not what comes out. Vectors with little structure have brackets that hold nearly every
score (on the test vectors nearly all rows are scored): the work is then that of anchors times rows in blocks.

Cases: rows with a null id, label or vector or a null component take no part, nor do vectors of another dimension
than the most common one (the least of those), nor components so large that a hundred scores pass a long; rows
repeated with id, label and vector count once; rows of one id with other labels or vectors are each an anchor,
and no row of an anchor's id is its positive; ties go to the smaller id; fewer rows than asked for give
fewer; a negative positive score has no negatives, since its bounds are the wrong way round; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspan.llm._shared import cut, ship

_NONE = np.iinfo(np.int64).min


class Pivots:
    """Pivot rows in the space with one more component, and the squared norm that it completes."""

    def __init__(self, sample: np.ndarray, most: int, pivots: int):
        self.most = float(most)
        self.at = sample[:0].astype(np.float64)
        self.last = np.zeros(0)
        if len(sample):
            last = self._last(sample)
            whole = np.concatenate([sample.astype(np.float64), last[:, None]], axis=1)
            far = ((whole - whole.mean(axis=0)) ** 2).sum(axis=1)
            chosen = []
            while len(chosen) < min(pivots, len(whole)) and far.max() > 0 or not chosen:  # the farthest from all so far
                chosen.append(int(far.argmax()))
                d = ((whole - whole[chosen[-1]]) ** 2).sum(axis=1)
                far = d if len(chosen) == 1 else np.minimum(far, d)
            self.at, self.last = whole[chosen, :-1], last[chosen]

    def _last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x.astype(np.float64) ** 2).sum(axis=1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """(n, pivots): distances of rows."""
        return np.sqrt(np.maximum(2 * self.most - 2 * (x.astype(np.float64) @ self.at.T + self._last(x)[:, None] * self.last), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """(n, pivots): distances of queries."""
        q = q.astype(np.float64)
        return np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.most - 2 * q @ self.at.T, 0))


class Block:
    """Anchors of one cell, and the best rows so far of each of their slots.

    wanted: (n, slots) scores of positives, or None for the search of positives, which has one slot. Slots
    without a positive hold the least integer."""

    def __init__(self, pivots: Pivots, ids, labels, vecs, k: int, wanted=None, low: int = 80, high: int = 100):
        self.pivots, self.k = pivots, k
        self.ids, self.labels, self.vecs = ids, labels, vecs
        self.far = pivots.of_queries(vecs)
        self.norm = (vecs.astype(np.float64) ** 2).sum(axis=1) + pivots.most
        self.wanted, self.low, self.high = wanted, low, high
        self.slots = 1 if wanted is None else wanted.shape[1]
        if wanted is not None:
            self.open = wanted >= 0
            self.floor = np.where(self.open, -(-(low * wanted) // 100), np.iinfo(np.int64).max)  # the least score of each slot
            self.top = np.where(self.open, high * wanted // 100, _NONE)
        self.key, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.worst = np.full(len(ids) * self.slots, _NONE)

    def bracket(self, a: slice, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that anchors `a` can have with rows of such pivot distances."""
        near, wide = np.zeros((a.stop - a.start, len(far))), np.full((a.stop - a.start, len(far)), np.inf)
        for j in range(far.shape[1]):
            q, x = self.far[a, j][:, None], far[:, j][None, :]
            np.maximum(near, np.abs(q - x), out=near)
            np.minimum(wide, q + x, out=wide)
        norm = self.norm[a][:, None]
        slack = 1e-6 * norm + 1
        return (norm - wide**2) / 2 - slack, (norm - near**2) / 2 + slack

    def exact(self, a: slice, vecs: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer scores of the pairs (q, x): all of the block's at once where most are wanted and doubles hold them."""
        mine = self.vecs[a]
        limit = float(np.abs(mine).max(initial=0)) * float(np.abs(vecs).max(initial=0)) * max(1, mine.shape[1])
        if limit < 2**53 and 8 * len(q) > len(mine) * len(vecs):
            return (mine.astype(np.float64) @ vecs.T.astype(np.float64))[q, x].astype(np.int64)
        parts = [np.einsum("ij,ij->i", mine[q[k : k + 50_000]], vecs[x[k : k + 50_000]]) for k in range(0, len(q), 50_000)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def see(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, far: np.ndarray) -> None:
        step = max(1, 500_000 // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            a = slice(at, min(len(self.ids), at + step))
            least, most = self.bracket(a, far)
            same = self.labels[a][:, None] == labels[None, :]
            if self.wanted is None:
                ok = same & (self.ids[a][:, None] != ids[None, :])
                bound = self.worst[a].astype(np.float64)
                if ok.shape[1] > self.k:  # k rows have at least this
                    sure = np.partition(np.where(ok, least, -np.inf), -self.k, axis=1)[:, -self.k]
                    bound = np.maximum(bound, sure)
                ok &= most >= bound[:, None]
            else:
                worst = self.worst.reshape(-1, self.slots)[a]
                bound = np.where(self.open[a], np.maximum(worst, self.floor[a]), np.iinfo(np.int64).max).min(axis=1)
                ok = ~same & (most >= bound[:, None]) & (least <= self.top[a].max(axis=1)[:, None])
            q, x = np.nonzero(ok)
            if len(q):
                self._take(q + at, ids[x], self.exact(a, vecs, q, x))

    def _take(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if self.wanted is None:
            key = q
        else:
            hit = (score[:, None] >= self.floor[q]) & (score[:, None] <= self.top[q])
            n, slot = np.nonzero(hit)
            key, ids, score = q[n] * self.slots + slot, ids[n], score[n]
        ok = score >= self.worst[key]
        key, ids, score = (np.concatenate([old, new[ok]]) for old, new in ((self.key, key), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        keep = nth < self.k
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]
        full = self.key[nth[keep] == self.k - 1]
        self.worst[full] = self.score[nth[keep] == self.k - 1]


def _vectors(column: pa.Array, dim: int, code: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=code).reshape(-1, dim)


def _clean(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, norm, vec): rows that take part, once each; vec holds little-endian 32-bit integers."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<long>").alias("v"))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    def run(batches):
        for b in batches:
            keep, dim, norm, vec = [], [], [], []
            for i, v in enumerate(b.column(2)):
                x = v.values.to_numpy(zero_copy_only=False)
                limit = min(2**31 - 1, int((2**63 - 1) // (100 * len(x))) ** 0.5)
                if -limit < x.min() and x.max() < limit:
                    keep.append(i)
                    dim.append(len(x))
                    norm.append(int((x * x).sum()))
                    vec.append(x.astype("<i4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dim, pa.int32()), pa.array(norm, pa.int64()), pa.array(vec, pa.binary())], names=["id", "label", "dim", "norm", "vec"])

    return src.mapInArrow(run, "id long, label long, dim int, norm long, vec binary").distinct()


def _cells(index: DataFrame, asked: DataFrame, label, parts: int, blocks) -> DataFrame:
    """(c1, c2, c3, kind, key, label, vec, far, wanted): anchors (kind 0) before rows, by label, block and part."""
    part = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(parts)).cast("int")
    out = ["c1", "c2", "c3", "kind", "key", "label", "vec", "far", "wanted"]
    queries = asked.withColumns({"c1": label, "c2": F.pmod(F.xxhash64("a", F.lit(3)), blocks).cast("int"), "c3": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "kind": F.lit(0), "key": F.col("a"), "far": F.lit(None).cast("binary")})
    rows = index.withColumn("key", F.col("id")).withColumns({"c1": label, "c2": F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))), "c3": part, "kind": F.lit(1), "wanted": F.lit(None).cast("array<long>")})
    ids = F.struct("key", F.col("id").alias("own"))
    both = queries.withColumn("key", ids).select(out).union(rows.withColumn("key", ids).select(out))
    return both.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3", "kind", "key")


def _found(cells: DataFrame, pivots, dim: int, k: int, slots: int, low: int, high: int) -> DataFrame:
    """(a, slot, id, score): the best rows of each anchor and slot in each cell."""
    flat = cells.select("c1", "c2", "c3", "kind", F.col("key.key").alias("key"), F.col("key.own").alias("own"), "label", "vec", "far", "wanted")

    def block(held, mining):
        keys = np.concatenate([b.column(4).to_numpy() for b in held])
        own, labels = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (5, 6))
        vecs = np.concatenate([_vectors(b.column(7), dim) for b in held]).astype(np.int64)
        wanted = None
        if mining:
            wanted = np.full((len(keys), slots), _NONE)
            for i, w in enumerate(w for b in held for w in b.column(9).to_pylist()):
                wanted[i, : len(w)] = w
        return keys, Block(pivots.value, own, labels, vecs, k, wanted, low, high)

    def run(batches):
        mining = slots > 0
        cell, held, keys, best = None, [], None, None

        def out():
            for at in range(0, len(best.key) if best else 0, 100_000):
                key = best.key[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[key // best.slots]), pa.array((key % best.slots).astype(np.int32)), pa.array(best.id[at : at + 100_000]), pa.array(best.score[at : at + 100_000])], names=["a", "slot", "id", "score"])

        for b in batches:
            at = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1, [b.num_rows]]) if b.num_rows else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if cell != tuple(at[:3, lo]):
                    yield from out()
                    cell, held, best = tuple(at[:3, lo]), [], None
                if at[3, lo] == 0:
                    held.append(part)
                elif held:
                    if best is None:
                        keys, best = block(held, mining)
                    best.see(part.column(5).to_numpy(), part.column(6).to_numpy(), _vectors(part.column(7), dim).astype(np.int64), _vectors(part.column(8), len(pivots.value.at), "<f8"))
        yield from out()

    return flat.mapInArrow(run, "a long, slot int, id long, score long")


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = 8, block_anchors: int = 16_384, sample_rows: int = 2_000, sample_bytes: int = 16_000_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    best `positives` rows of the same label, the first `negatives` rows of other labels whose score lies between
    low and high percent of the positive's, both included. vec_col: arrays of integers; label_col: integers.
    is_anchor: a condition on the column `id`."""
    spark = df.sparkSession
    ship(spark)
    clean = cut(_clean(df, id_col, vec_col, label_col), "integer_vectors")
    common = clean.groupBy("dim").agg(F.count(F.lit(1)).alias("count"), F.max("norm").alias("most")).orderBy(F.desc("count"), "dim").first()
    dim, n, most = (common["dim"], common["count"], common["most"]) if common else (1, 0, 0)
    rows = clean.where(F.col("dim") == dim)
    some = rows.orderBy(F.xxhash64("id", F.lit(3)), "id", "label", "vec").limit(max(1, min(sample_rows, sample_bytes // (8 * dim)))).select("vec").toArrow()
    chosen = Pivots(_vectors(some["vec"], dim), most, pivots)
    sent = spark.sparkContext.broadcast(chosen)

    def distances(batches):
        for b in batches:
            far = sent.value.of_rows(_vectors(b.column(2), dim)).astype("<f8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f.tobytes() for f in far], pa.binary())], names=["id", "label", "vec", "far"])

    table = cut(rows.select("id", "label", "vec").mapInArrow(distances, "id long, label long, vec binary, far binary"), "pivot_table")
    nth = Window.partitionBy("label", "vec").orderBy("id")
    index = cut(table.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= max(positives, negatives) + 1).drop("nth"), "pivot_index")
    asked = cut(table.where(is_anchor).select(F.monotonically_increasing_id().alias("a"), "id", "label", "vec"), "anchors")
    parts = max(1, -(-n // min(block_anchors, max(256, n // 64))))
    per = asked.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_anchors).cast("int").alias("blocks"))
    first = _cells(index.join(per, "label"), asked.join(per, "label").withColumn("wanted", F.lit(None).cast("array<long>")), F.col("label"), parts, F.col("blocks"))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    found = _found(first, sent, dim, positives, 0, low, high).withColumn("slot", F.row_number().over(best) - 1).where(F.col("slot") < positives)
    pos = cut(found.join(asked.select("a", F.col("id").alias("anchor_id")), "a").select("a", "anchor_id", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = pos.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
    blocks = F.lit(max(1, -(-asked.count() // block_anchors)))
    second = _cells(index, asked.join(wanted, "a"), F.lit(0).cast("long"), parts, blocks)
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    negative = _found(second, sent, dim, negatives, positives, low, high).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return negative.join(pos, ["a", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
