"""SimHash near-duplicates by pigeonring filtering.

`fingerprints` hashes every word shingle of a whole text. `near_links` finds fingerprints at most
`max_bits` apart: 64 bits are a ring of max_bits + 1 segments. If two fingerprints are that near,
some segment starts a chain in which the first l segments together differ in at most
l * max_bits / segments bits, for every l (the pigeonring principle). The first segment of such a
chain agrees and the second differs in one bit at most, so one of its halves agrees too: pairs
meet on the key (start, first segment, half of the second), pass the chain test over the further
segments, and only then the full Hamming check.

Groups: copies of a text share a fingerprint and are one node. The fingerprints of one key are
linked as a spanning forest where they are many, not as all pairs: a search takes every unvisited
neighbour at once, so a dense group of n costs about n steps and gives n - 1 links, with the same
components as all pairs. A key with more than `max_run` fingerprints is dealt as pairs of blocks to several tasks.

`near_texts` groups texts by the similarity of their shingle sets. Texts at a similarity of 0.8 differ
in about 10 of 64 bits, too many for segments that must agree, so prints are wider there (8 words and
more) and pairs meet on any of many blocks, by the same chains (see `blocks`). `recall` is the chance
wanted for a pair at just the similarity asked for; nearer pairs have a better one. What meets is held
against the whole prints, and pairs that these do not settle against the sets of shingles themselves.

Cases: a null or wordless text has fingerprint zero (in `near_texts` the empty shingle) and links like
any other; a text of fewer words than a shingle is one shingle; equal rows share a component; a null id
never names a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.llm._shared import cut, ship
from ringspan.llm.blocks import blocks_for, by_key, groups, print_columns, wide_print
from ringspan.llm.components import components


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: ASCII lower case, words between ASCII white space, XXH64."""
    from xxhash import xxh64_intdigest as xxh

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 32768):
        h = np.array([xxh(flat[a:b], seed) for a, b in zip(starts[k : k + 32768], stops[k : k + 32768], strict=True)], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of each row, as a signed 64-bit integer."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = T.StructType([src.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, out)


#: Bits of a key below those that number its start and half: a segment and a half at most.
KEY_BITS = 48


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each of max_bits + 1 segments of 64 bits."""
    n = max_bits + 1
    at = [64 * k // n for k in range(n + 1)]
    return [(at[k], at[k + 1] - at[k]) for k in range(n)]


def chain_keys(fp: str, max_bits: int) -> list[Column]:
    """What a fingerprint's partners can meet on: a key for every start and half, in the JVM."""
    seg = _segments(max_bits)
    v = F.col(fp)
    take = lambda lo, n: F.shiftrightunsigned(v, lo).bitwiseAND(F.lit((1 << n) - 1))
    out = []
    for s, (shift, width) in enumerate(seg):
        nxt, wide = seg[(s + 1) % len(seg)]
        for half, (lo, w) in enumerate(((nxt, wide // 2), (nxt + wide // 2, wide - wide // 2))):
            first = F.shiftleft(take(shift, width), w).bitwiseOR(take(lo, w))
            out.append(first.bitwiseOR(F.lit((2 * s + half) << KEY_BITS)))
    return out


def _chain(x: np.ndarray, max_bits: int, start: int) -> np.ndarray:
    """Whether differences pass the chain from a start, the last step being the Hamming check."""
    seg = _segments(max_bits)
    ok, total = np.ones(x.shape, dtype=bool), np.zeros(x.shape, dtype=np.uint8)
    for step in range(1, len(seg) + 1):
        shift, width = seg[(start + step - 1) % len(seg)]
        total += np.bitwise_count(x & np.uint64(((1 << width) - 1) << shift))
        ok &= total * len(seg) <= step * max_bits
        if not ok.any():
            break
    return ok


def forest(fps: np.ndarray, max_bits: int, start: int) -> list[tuple[int, int]]:
    """Pairs (position, position) that pass the chain and span what all such pairs join."""
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            part, frontier = frontier[:64], frontier[64:]
            hit = _chain(fps[part][:, None] ^ fps[left][None, :], max_bits, start)
            found = hit.any(axis=0)
            if found.any():
                by = part[hit[:, found].argmax(axis=0)]
                links += zip(left[found].tolist(), by.tolist(), strict=True)
                frontier, left = np.concatenate([frontier, left[found]]), left[~found]
    return links


def run_links(run: np.ndarray, fps: np.ndarray, starts: np.ndarray, max_bits: int, short: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links inside runs of equal numbers. All pairs of short runs are tested at
    once; a run with more hits than members, or a long one, gives a forest instead, which joins the same."""
    n = len(run)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [n]])
    size = np.diff(edges)
    of = np.repeat(np.arange(len(size)), size)
    small = size[of] <= short
    a, b = [], []
    live = np.flatnonzero(small & (size[of] > 1))
    for off in range(1, short):
        live = live[live + off < edges[of[live] + 1]]
        if not len(live):
            break
        x = fps[live] ^ fps[live + off]
        for s in range(max_bits + 1):
            mine = np.flatnonzero(starts[live] == s)
            hit = mine[_chain(x[mine], max_bits, s)] if len(mine) else mine
            a.append(live[hit])
            b.append(live[hit] + off)
    a, b = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (a, b))
    hits = np.bincount(of[a], minlength=len(size)) if len(a) else np.zeros(len(size), dtype=np.int64)
    dense = (hits > size) | (size > short)
    keep = ~dense[of[a]] if len(a) else np.zeros(0, dtype=bool)
    a, b = [a[keep]], [b[keep]]
    for r in np.flatnonzero(dense):
        lo, hi = edges[r], edges[r + 1]
        got = np.array(forest(fps[lo:hi], max_bits, int(starts[lo])), dtype=np.int64).reshape(-1, 2)
        a.append(got[:, 0] + lo)
        b.append(got[:, 1] + lo)
    return np.concatenate(a), np.concatenate(b)


def _cells(nodes: DataFrame, max_bits: int, max_run: int, sampled: int) -> DataFrame:
    """(key, fp) of fingerprints by key, and the cell if there are keys to be dealt as pairs of blocks:
    those with more than about max_run, found on one fingerprint in `sampled`."""
    keyed = lambda df: df.select(F.explode(F.array(*chain_keys("fp", max_bits))).alias("key"), "fp")
    part = keyed(nodes.where(F.pmod(F.xxhash64("fp", F.lit(13)), F.lit(sampled)) == 0)).groupBy("key").count()
    large = cut(part.where(F.col("count") * sampled > max_run / 2).select(F.col("key").alias("hot"), F.ceil(F.col("count") * sampled / max_run).cast("int").alias("blocks")), "large")
    rows = keyed(nodes)
    if large.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key")
    # each row meets every block of its key: cell (a, b) holds the blocks a and b
    joined = rows.join(large, rows["key"] == large["hot"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    joined = joined.withColumn("a", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return joined.select("key", "fp", (F.least("a", "b") * F.col("blocks") + F.greatest("a", "b")).cast("long").alias("cell")).repartition("key", "cell").sortWithinPartitions("key", "cell")


def near_links(nodes: DataFrame, max_bits: int = 3, max_run: int = 20_000, sampled: int = 64) -> DataFrame:
    """(u, v), u > v: links between the distinct fingerprints of nodes (fp) whose components are those of
    all pairs at most max_bits apart.

    Keys with more than about max_run fingerprints are found on one in `sampled` and dealt as pairs of
    blocks; that choice is about where the work is done, not about what is compared."""
    ship(nodes.sparkSession)

    def found(t):
        same = np.diff(t[0]) == 0  # a key that one row has links nothing
        t = t[:, np.append(same, False) | np.insert(same, 0, False)] if t.shape[1] else t
        if t.shape[1] < 2:
            return
        t = t[:, np.lexsort((t[1], *t[2:], t[0]))]
        turn = np.diff(t[0]) != 0
        if len(t) == 3:
            turn |= np.diff(t[2]) != 0
        a, b = run_links(np.concatenate([[0], np.cumsum(turn)]), t[1].view(np.uint64), (t[0] >> KEY_BITS) // 2, max_bits)
        if len(a):
            a, b = t[1][a], t[1][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    cells = _cells(nodes.select("fp"), max_bits, max_run, sampled)
    return cells.mapInArrow(lambda batches: by_key(batches, 2, found), "u long, v long").where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id): the fingerprint of each row and the least id that links reach."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(near_links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(named.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(by_fp, "fp").select("id", "fp", "component_id")


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted digests of a text's distinct shingles: ASCII lower case, words between ASCII white space."""
    from xxhash import xxh64_intdigest as xxh

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1)
    return np.array(sorted({xxh(b" ".join(words[i : i + shingle])) for i in range(n)}), dtype=np.uint64)


def expected_difference(similarity: float) -> float:
    """The share of bits in which the prints of two sets of this Jaccard similarity differ: the angle
    between them over pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _set_prints(rows: DataFrame, row_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(row, size, p0, p1...): the number of distinct shingles and their wide print."""
    src = rows.select(F.col(row_col).cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = print_columns(words)

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(1)]
            made = np.array([wide_print(h, words) for h in sets], dtype=np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(np.ascontiguousarray(made[:, k]).view(np.int64)) for k in range(words))], names=["row", "size", *names])

    return src.mapInArrow(run, ", ".join(f"{c} long" for c in ("row", "size", *names)))


#: Sets of fewer shingles are held against each other themselves, whatever their prints say.
FEW = 64


def _near_sets(links: DataFrame, nodes: DataFrame, rows: DataFrame, row_col: str, text_col: str, shingle: int, similarity: float, words: int) -> DataFrame:
    """The links (u, v) whose sets have the similarity. The standard deviation of the share of differing
    bits is s = sqrt(d (1 - d) / bits): a share of 4 s and more off the expected one settles a pair of
    large sets; the sets of the others are made again from the texts and compared."""
    d, n = expected_difference(similarity), 64 * words
    off = 4 * float(np.sqrt(d * (1 - d) / n))
    low, high = (d - off) * n, (d + off) * n
    names = print_columns(words)
    side = lambda end: nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("size", *names)])

    def settle(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.stack([b.column(f"{end}_size").to_numpy() for end in "uv"])
            apart = sum(np.bitwise_count((b.column(f"u_{c}").to_numpy() ^ b.column(f"v_{c}").to_numpy()).view(np.uint64)).astype(np.int64) for c in names)
            few = sizes.min(axis=0) < FEW
            keep = np.flatnonzero((few | (apart <= high)) & (sizes.min(axis=0) + 1e-9 >= similarity * sizes.max(axis=0)))
            yield pa.RecordBatch.from_arrays([b.column("u").take(pa.array(keep)), b.column("v").take(pa.array(keep)), pa.array(~few[keep] & (apart[keep] < low))], names=["u", "v", "sure"])

    told = cut(links.join(side("u"), "u").join(side("v"), "v").mapInArrow(settle, "u long, v long, sure boolean"), "settled")
    open_links = told.where("not sure").select("u", "v")
    ends = cut(open_links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "set_ends")
    texts = rows.select(F.col(row_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ends, "node", "left_semi")

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], names=["node", "held"])

    sets = cut(texts.select("node", "text").mapInArrow(held, "node long, held binary"), "sets")
    whole = lambda end: sets.select(F.col("node").alias(end), F.col("held").alias(f"{end}_held"))

    def near(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(h.as_py(), dtype=np.uint64) for h in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common + 1e-9 >= similarity * (len(x) + len(y) - common))
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    checked = open_links.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "u_held", "v_held").mapInArrow(near, "u long, v long")
    return cut(told.where("sure").select("u", "v").union(checked), "near_links")


def near_texts(rows: DataFrame, row_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(row, root): the group of each row, named by its least row; texts whose sets of shingles have a Jaccard
    similarity of at least `similarity` share a group. rows: a written table, with a row key of its own
    (long, never null)."""
    ship(rows.sparkSession)
    b = blocks_for(rows.count(), expected_difference(similarity), recall, least_words=8)
    prints = cut(_set_prints(rows, row_col, text_col, shingle, b.words), "set_prints")
    same = ["size", *print_columns(b.words)]
    nodes = cut(prints.groupBy(*same).agg(F.min("row").alias("node")), "set_nodes")
    roots = groups(nodes, b, lambda links: _near_sets(links, nodes, rows, row_col, text_col, shingle, similarity, b.words), similarity)
    named = nodes.join(roots, "node", "left").select(*same, F.coalesce("root", "node").alias("root"))
    return prints.join(named, same).select("row", "root")
