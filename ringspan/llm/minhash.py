"""Near-duplicates by b-bit MinHash.

A document's set holds its distinct word shingles. `signatures` takes the minimum of the set under each of
`hashes` hash functions; of each minimum only the low `BITS` bits are kept, packed as bit planes, so two
signatures are compared by a few exclusive-ors and a bit count. Bands of `rows` whole minima each, hashed to one
key, give the candidates. Two minima that differ agree in their low bits with a chance of c = 2^-BITS; the
share of agreeing places is therefore c + (1 - c) J, and J is estimated from it. A candidate whose estimate lies
`DEVIATIONS` standard deviations under the wanted similarity goes; the others are confirmed on whole sets. At a
similarity of just 0.85, 24 bands of 5 rows miss a pair with a chance of 8 in ten million.

Groups: documents of equal sets are one node. Of the nodes of a key a forest of candidates leaves first: a search
from the node that is most like the others takes all its neighbours at once, so a dense group of n costs few
steps and gives n - 1 pairs. Nodes that may have more pairs than that are marked. Keys whose marked nodes still lie in
several components, once those pairs have been confirmed, are looked at again where their nodes meet, now with whole sets: every
candidate pair of two components is confirmed or refuted on the spot, the likeliest first, and a link leaves only
where it joins two components. So the components are those of all candidate pairs, and no group emits the square of its members.

Scale: documents are read in place and leave the scan as signatures (under 400 bytes). A shuffle brings the band
keys together; keys of more than about `max_run` nodes are dealt as pairs of parts to many tasks. Texts of
candidates are read again for their sets. Nothing is collected to the driver; every step that is used twice
is written to the shared folder.

Cases: a text of fewer words than a shingle is one shingle; one without words, or null, has an empty set and
links with nothing, so it is its own component; rows of equal sets share a component, repeated rows among them;
a null id never names a component (that of null ids alone is null) and such a row is kept only where no other
names its component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.llm._shared import cut, few_tasks, ship
from ringspan.llm.blocks import by_key, joined_roots
from ringspan.llm.components import components
from ringspan.llm.line_dedup import _passes, bloom
from ringspan.llm.simhash import shingles

#: Low bits of each minimum that a signature keeps.
BITS = 2
#: Standard deviations of an estimate under the wanted similarity at which a candidate goes.
DEVIATIONS = 5.0
#: Bytes of whole sets that one part of a key holds in the second look; a task has two parts at a time.
CELL_BYTES = 32_000_000


class Functions:
    """The hash functions: h -> (h xor a) * b in 64 bits, one for each place of a signature."""

    def __init__(self, hashes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, hashes, dtype=np.uint64, endpoint=False)
        self.b = rng.integers(0, 2**64, hashes, dtype=np.uint64, endpoint=False) | np.uint64(1)

    def minima(self, h: np.ndarray) -> np.ndarray:
        """The least value of each function over a set's digests."""
        out = np.full(len(self.a), 2**64 - 1, dtype=np.uint64)
        for k in range(0, len(h), 256):
            part = h[k : k + 256, None] ^ self.a
            part *= self.b
            np.minimum(out, part.min(axis=0), out=out)
        return out


def packed(minima: np.ndarray) -> np.ndarray:
    """(n, BITS * hashes / 64): the low bits of (n, hashes) minima, one plane of bits behind the other."""
    planes = [np.packbits((minima >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8") for k in range(BITS)]
    return np.concatenate(planes, axis=1)


def agreeing(x: np.ndarray, y: np.ndarray, hashes: int) -> np.ndarray:
    """At how many places two packed signatures (last axis: words) agree in all low bits."""
    d = x ^ y
    w = d.shape[-1] // BITS
    apart = d[..., :w].copy()
    for k in range(1, BITS):
        apart |= d[..., k * w : (k + 1) * w]
    return hashes - np.bitwise_count(apart).sum(axis=-1, dtype=np.int64)


def estimate(agree, hashes: int):
    """The similarity that so many agreeing places speak for, corrected for low bits that agree by chance."""
    c = 2.0**-BITS
    return (np.asarray(agree) / hashes - c) / (1 - c)


def least_agreeing(similarity: float, hashes: int, deviations: float = DEVIATIONS) -> int:
    """The fewest agreeing places of a candidate that stays."""
    c = 2.0**-BITS
    p = c + (1 - c) * similarity
    return max(0, int(np.floor(hashes * p - deviations * np.sqrt(hashes * p * (1 - p)))))


def band_keys(minima: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(n, bands) keys of (n, hashes) minima: the number of the band in the low 8 bits, a hash of its minima above."""
    n = len(minima)
    h = np.zeros((n, bands), dtype=np.uint64)
    part = minima[:, : bands * rows].reshape(n, bands, rows)
    for k in range(rows):
        h = (h ^ part[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h << np.uint64(8) | np.arange(bands, dtype=np.uint64)).view(np.int64)


def _words(hashes: int) -> list[str]:
    return [f"s{k}" for k in range(BITS * hashes // 64)]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, hashes: int = 192, rows: int = 5, bands: int = 24, seed: int = 11) -> DataFrame:
    """(id, rep, n, d1, d2, s0..., bands): the size of each row's set, the 128-bit digest of the set, its packed
    signature and its band keys (none for an empty set). rep names the row by a hash of id and text."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = _words(hashes)
    kinds = [T.StructField(c, T.LongType()) for c in ("rep", "n", "d1", "d2", *names)]
    out = T.StructType([src.schema["id"], *kinds, T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        of = Functions(hashes, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [_set_of(t.as_py(), shingle) for t in b.column(2)]
                made = np.stack([of.minima(h) for h in sets]) if sets else np.zeros((0, hashes), dtype=np.uint64)
                digest = _digests([h.tobytes() for h in sets])
                full = np.array([len(h) for h in sets], dtype=np.int64)
                sig, keys = packed(made), band_keys(made, rows, bands)
                ends = np.concatenate([[0], np.cumsum((full > 0) * keys.shape[1])])
                held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[full > 0].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(full), pa.array(digest[0]), pa.array(digest[1]), *(pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in range(len(names))), held], names=out.names)

    return src.mapInArrow(run, out)


def _set_of(text: str, shingle: int) -> np.ndarray:
    """The sorted digests of a text's distinct shingles; none without words."""
    return shingles(text, shingle) if text.strip(" \t\n\x0b\x0c\r") else np.zeros(0, dtype=np.uint64)


def _digests(parts: list[bytes]) -> np.ndarray:
    """The two 64-bit halves of a digest of each."""
    from xxhash import xxh3_128_digest

    return np.ascontiguousarray(np.frombuffer(b"".join(xxh3_128_digest(p) for p in parts), dtype="<i8").reshape(-1, 2).T)


def _cells(nodes: DataFrame, hashes: int, max_run: int, sampled: int) -> DataFrame:
    """(key, n, node, s0...[, cell]) of nodes by key; cells if there are keys to be dealt as pairs of parts:
    those with more than about max_run nodes, found on one node in `sampled`."""
    keyed = lambda df: df.select(F.explode("bands").alias("key"), "n", "node", *_words(hashes))
    part = keyed(nodes.where(F.pmod(F.xxhash64("node", F.lit(13)), F.lit(sampled)) == 0)).groupBy("key").count()
    large = cut(part.where(F.col("count") * sampled > max_run / 2).select(F.col("key").alias("hot"), F.ceil(F.col("count") * sampled / max_run).cast("int").alias("parts")), "large")
    rows = keyed(nodes)
    if large.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key")
    joined = rows.join(large, rows["key"] == large["hot"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return _in_parts(joined, rows.columns).repartition("key", "cell").sortWithinPartitions("key", "cell")


def _in_parts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (node, parts, ...) once for every part of their key, so that each meets each: cell (x, y) holds the parts x and y."""
    both = rows.withColumn("x", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.select(*columns, (F.least("x", "y") * F.col("parts") + F.greatest("x", "y")).cast("long").alias("cell"))


def _runs(t: np.ndarray, width: int) -> np.ndarray:
    """The bounds of the runs of equal key (and cell)."""
    turn = np.diff(t[0]) != 0
    if len(t) > width:
        turn |= np.diff(t[width]) != 0
    return np.concatenate([[0], np.flatnonzero(turn) + 1, [t.shape[1]]])


class _Alike:
    """The test of candidates: sizes in reach of each other and enough agreeing places."""

    def __init__(self, t: np.ndarray, percent: int, hashes: int):
        self.n, self.node = t[1], t[2]
        self.sig = np.ascontiguousarray(t[3 : 3 + len(_words(hashes))].T).view(np.uint64)
        self.percent, self.hashes, self.least = percent, hashes, least_agreeing(percent / 100, hashes)

    def agree(self, a, b) -> np.ndarray:
        """The agreeing places of rows a and b; -1 where they are no candidates."""
        got = agreeing(self.sig[a], self.sig[b], self.hashes)
        small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        got[(got < self.least) | (100 * small < self.percent * large) | (self.node[a] == self.node[b])] = -1
        return got

    def forest(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that span what candidates lo..hi - 1 join; the first search begins where the rows are most alike."""
        left, u, v = np.arange(lo, hi), [], []
        if hi - lo > 8:
            some = left[:: max(1, (hi - lo) // 16)]
            first = int(np.sum([agreeing(self.sig[lo:hi], self.sig[s], self.hashes) for s in some], axis=0).argmax())
            left = np.concatenate([left[first : first + 1], np.delete(left, first)])
        while len(left) > 1:
            frontier, left, at = [left[:1]], left[1:], 0
            while at < len(frontier) and len(left):
                for c in frontier[at]:
                    hit = self.agree(c, left) >= 0
                    if hit.any():
                        u.append(left[hit])
                        v.append(np.full(len(u[-1]), c))
                        frontier.append(u[-1])
                        left = left[~hit]
                    if not len(left):
                        break
                at += 1
        empty = np.zeros(0, dtype=np.int64)
        return (np.concatenate(u), np.concatenate(v)) if u else (empty, empty)


def _named(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def candidates(nodes: DataFrame, percent: int, hashes: int, max_run: int = 20_000, sampled: int = 64) -> DataFrame:
    """(u, v), u > v: candidate pairs that span those of each key. Nodes that may have more are marked: (u, u).
    nodes: (node, n, s0..., bands), one row for each set, a written table."""
    width = 3 + len(_words(hashes))

    def found(t):
        edges = _runs(t, width)
        size = np.diff(edges)
        alike = _Alike(t, percent, hashes)
        two = edges[:-1][size == 2]
        two = two[alike.agree(two, two + 1) >= 0]
        u, v, mark = [two + 1], [two], []
        for k in np.flatnonzero(size > 2):
            a, b = alike.forest(edges[k], edges[k + 1])
            u.append(a)
            v.append(b)
            mark += [a, b] if len(a) > 1 else []
        u, v, mark = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (u, v, mark))
        mark = np.unique(alike.node[mark])
        if len(u):
            yield _named(np.concatenate([alike.node[u], mark]), np.concatenate([alike.node[v], mark]))

    return _cells(nodes, hashes, max_run, sampled).mapInArrow(lambda batches: by_key(batches, width, found), "u long, v long").distinct()


class _Sets:
    """The whole sets of some rows, one behind the other."""

    def __init__(self, parts: list[np.ndarray]):
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.end = np.cumsum(self.size)
        self.flat = np.concatenate(parts)

    def of(self, row: int) -> np.ndarray:
        return self.flat[self.end[row] - self.size[row] : self.end[row]]

    def linked(self, row: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others have the similarity with a row."""
        mine, size = self.of(row), self.size[others]
        at = np.repeat(self.end[others] - np.cumsum(size), size) + np.arange(size.sum())
        held = self.flat[at]
        hit = mine[np.minimum(np.searchsorted(mine, held), len(mine) - 1)] == held
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        return 100 * common >= percent * (size + len(mine) - common)


def joining(alike: _Alike, sets: _Sets, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Linked pairs (row, row) that join the components of a key's rows as all its linked candidates do."""
    root, out = root.copy(), []
    names, n = np.unique(root, return_counts=True)
    for row in np.flatnonzero(root != names[n.argmax()]):
        other = np.flatnonzero(root != root[row])
        got = alike.agree(row, other)
        other = other[got >= 0][np.argsort(-got[got >= 0], kind="stable")]
        at, step = 0, 8  # the likeliest few, then ever more of those that are not joined yet
        while at < len(other):
            part = other[at : at + step]
            part = part[root[part] != root[row]]
            for hit in part[sets.linked(row, part, percent)] if len(part) else ():
                if root[hit] != root[row]:
                    out.append((int(row), int(hit)))
                    root[root == root[hit]] = root[row]
            at, step = at + step, 4 * step
    return out


def joined_on_sets(nodes: DataFrame, sets: DataFrame, percent: int, hashes: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(u, v): links between nodes (node, n, s0..., bands, root) of unlike roots that meet on a key, such that the components are
    those of all such links. sets: (node, held)."""
    names = _words(hashes)
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "n", "root")
    load = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("n").alias("load")).where("a <> b")
    load = load.select("key", F.ceil(8 * F.col("load") / cell_bytes).cast("int").alias("parts"))
    rows = _in_parts(keyed.select("key", "node").join(load, "key"), ["key", "node"])
    whole = nodes.select("node", "n", "root", *names).join(sets, "node")
    dealt = rows.join(whole, "node").select("key", "cell", "n", "node", "root", *names, "held").repartition("key", "cell").sortWithinPartitions("key", "cell")

    def found(batches):
        part, key = [], None

        def links():
            t = pa.Table.from_batches(part)
            cols = [t.column(c).to_numpy() for c in ("key", "n", "node", *names)]
            root = t.column("root").to_numpy()
            if len(root) < 2 or (root == root[0]).all():
                return
            alike = _Alike(np.stack(cols), percent, hashes)
            held = _Sets([np.frombuffer(x.as_buffer(), dtype=np.uint64) for c in t.column("held").chunks for x in c])
            got = np.array(joining(alike, held, root, percent), dtype=np.int64).reshape(-1, 2)
            if len(got):
                yield _named(alike.node[got[:, 0]], alike.node[got[:, 1]])

        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in (0, 1)])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1, [b.num_rows]]) if b.num_rows else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if key != tuple(at[:, lo]):
                    if part:
                        yield from links()
                    part, key = [], tuple(at[:, lo])
                part.append(b.slice(lo, hi - lo))
        if part:
            yield from links()

    return dealt.mapInArrow(found, "u long, v long").distinct()


def whole_sets(links: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, held): the whole set of each end of links (u, v), made again from the text of one document. Texts are read again in
    place, and only sets leave the scan: those whose document a Bloom filter lets through while it is small; of more
    candidates than it may hold, those that a join finds."""
    with few_tasks(docs.sparkSession):
        ends = cut(nodes.select("node", "rep", "d1", "d2").join(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi"), "minhash_ends")
    have = bloom(ends.select(F.col("rep").alias("key")), ends.count())
    sent = docs.sparkSession.sparkContext.broadcast(have)
    src = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("rep"), F.col(text_col).alias("text"))
    if have is None:
        src = src.join(ends.select("rep").distinct(), "rep", "left_semi")

    def held(batches):
        seen: set[int] = set()  # rows that are repeated leave once or, in tasks with very many, a few times
        for b in batches:
            rep = b.column(0).to_numpy()
            pick = np.arange(len(rep)) if sent.value is None else np.flatnonzero(_passes(sent.value, rep))
            pick = [i for i in pick.tolist() if rep[i] not in seen and not seen.add(rep[i])]
            if len(seen) > 200_000:
                seen.clear()
            for at in range(0, len(pick), 500):
                sets = [_set_of(b.column(1)[i].as_py(), shingle).tobytes() for i in pick[at : at + 500]]
                d = _digests(sets)
                yield pa.RecordBatch.from_arrays([pa.array(d[0]), pa.array(d[1]), pa.array(sets, pa.binary())], names=["d1", "d2", "held"])

    found = src.mapInArrow(held, "d1 long, d2 long, held binary").join(ends.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "held")
    return cut(found.dropDuplicates(["node"]), "minhash_sets")


def confirmed(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) whose whole sets have the similarity: 100 * intersection >= percent * union."""
    whole = lambda end: sets.select(F.col("node").alias(end), F.col("held").alias(f"{end}_held"))

    def near(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(h.as_buffer(), dtype=np.uint64) for h in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    return cut(links.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "u_held", "v_held").mapInArrow(near, "u long, v long"), "minhash_links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85, hashes: int = 192, rows: int = 5, bands: int = 24) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents link where 100 * intersection >= percent * union of their
    sets; component_id is the least id that links reach; kept, whether the row's own id is that."""
    spark = docs.sparkSession
    names = _words(hashes)
    made = cut(signatures(docs, id_col, text_col, shingle, hashes, rows, bands), "signatures")
    same = made.where("n > 0").groupBy("d1", "d2").agg(F.min("rep").alias("rep"), F.min("id").alias("least"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in names], F.min("bands").alias("bands"))
    nodes = cut(same.withColumn("node", F.monotonically_increasing_id()), "minhash_nodes")
    found = cut(candidates(nodes, percent, hashes), "candidates")
    links = found.where("u <> v")
    sets = whole_sets(links, nodes, docs, id_col, text_col, shingle)
    roots = components(confirmed(links, sets, percent))
    marked = found.where("u = v").select(F.col("u").alias("node"))
    if not marked.isEmpty():
        with few_tasks(spark):
            open_ = cut(nodes.join(marked, "node", "left_semi").join(roots, "node", "left").select("node", "n", *names, "bands", F.coalesce("root", "node").alias("root")), "minhash_open")
            more = cut(joined_on_sets(open_, sets, percent, hashes), "minhash_links")
        if not more.isEmpty():
            roots = cut(joined_roots(roots, more), "minhash_roots")
    named = nodes.join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = cut(named.join(least, "root").select("d1", "d2", "component_id"), "minhash_named")
    joined = made.where("n > 0").select("id", "n", "d1", "d2").join(by_set, ["d1", "d2"]).select("id", "n", "component_id")
    every = joined.union(made.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
