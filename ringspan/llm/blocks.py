"""Wide SimHashes, the pairs that meet on their blocks, and the groups that verified pairs form.

A print of several 64-bit words is a ring of bits. Blocks of it are keys: two prints as far apart as
texts at the wanted similarity agree on some block with a known chance, so the number of blocks
follows from their width and the recall that is wanted (`blocks_for`). Where they meet, the block is
the start of a pigeonring chain: the differences in the segments that follow it on the ring, summed
from the block on, must stay within `budget` bits a segment for every length of the chain, and those in
the 64 bits behind it and in the last word of the ring together within 1.1 times their share.

`groups` verifies pairs before anything joins them. Of the pairs of a key a least spanning forest leaves
first, by the difference in the prints' last words, which every key sees alike; rows that have more pairs
than that are marked. When the verified pairs have been joined, marked rows that still lie in two groups put forward the
nearest few of such pairs each, then sixteen times as many, and so on until none has more. So the groups are those of
all pairs that meet, and a dense group emits the square of its rows only where its pairs must be refuted one by one.

Scale: entries of blocks are dealt by their keys, those of some keys together as bytes, some 500,000 at a time, so Spark moves
few rows; a key that holds more than about `max_run` goes row by row instead, as pairs of parts, to many tasks;
rows inside a key are ordered by size and compared only as far as sizes allow, about a million pairs at a time, which
leave as they are found.

Cases: nodes without a partner have no row; nodes of equal prints meet on every block; prints of no words are all
zeros and meet like any other; an empty table gives no rows. Blocks get wider with the table, so whether two rows
that are less alike than asked for meet depends on its size; those that are alike meet with the chance asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspan.llm._shared import cut, ship
from ringspan.llm.components import components

#: Bits of a key below those that number its block.
KEY_BITS = 40
#: What the 64 bits behind a block and the last word may differ in together, as a multiple of their share.
TOGETHER = 1.1
#: Pairs of a key that are held at once, for each of its rows; beyond, its forest grows row by row.
LIMIT = 8
#: Pairs of a row that are put forward once a forest of its key has been tried, and the factor by which they grow.
AT_FIRST, GROWTH = 64, 16
#: Entries that are dealt to the parts of their keys at a time, and bits of a part's number at most.
DEALT, PART_BITS = 500_000, 13


class Blocks(NamedTuple):
    """How prints meet: words of a print, bits of a block, blocks, and bits of a segment that may differ."""

    words: int
    bits: int
    count: int
    budget: float


def blocks_for(n: int, differ: float, recall: float, budget: float = 0.25, least_words: int = 1) -> Blocks:
    """Blocks of about log2(n) - 9 bits, 12 at least, so that a row meets a few hundred others by chance
    on each, and as many blocks as `recall` takes where `differ` of the bits are unlike. A corpus a
    thousand times larger takes blocks ten bits wider and, at a tenth of the bits, three times as many."""
    bits = min(KEY_BITS, max(12, int(math.log2(max(n, 1))) - 9))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
    return Blocks(max(least_words, -(-count * bits // 64)), bits, count, budget * bits)


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hashes out of one each."""
    by = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) for k in range(words)], dtype=np.uint64)
    y = (h ^ (h >> np.uint64(31)))[:, None] * by
    y ^= y >> np.uint64(29)
    return y


def bits_of(h: np.ndarray, words: int) -> np.ndarray:
    """(n, 64 * words) bits of the hashes that `spread` gives."""
    return np.unpackbits(spread(h, words).view(np.uint8).reshape(len(h), 8 * words), axis=1, bitorder="little")


def wide_print(h: np.ndarray, words: int) -> np.ndarray:
    """The print of a set of hashes: each bit that more than half of them have."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, len(h), 255):
        ones += np.add.reduce(bits_of(h[k : k + 255], words), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def print_columns(words: int) -> list[str]:
    """The names of a print's words, each a signed 64-bit integer."""
    return [f"p{k}" for k in range(words)]


def _at(prints: np.ndarray, pos: int) -> np.ndarray:
    """64 bits of each ring from a position on."""
    words = prints.shape[1]
    lo, off = pos // 64 % words, np.uint64(pos % 64)
    out = prints[:, lo] >> off
    if off:
        out = out | prints[:, (lo + 1) % words] << (np.uint64(64) - off)
    return out


def _budget(b: Blocks) -> int:
    """How many of the 64 bits behind a block may differ."""
    return min(64, int((1 + 64 / b.bits) * b.budget))


def _chain(x: np.ndarray, b: Blocks) -> np.ndarray:
    """Whether differences behind a block that agrees stay within the budget at every length."""
    ok = np.bitwise_count(x) <= _budget(b)
    at = np.flatnonzero(ok)
    for k in range(1, 64 // b.bits + 1):
        part = x[at] & np.uint64((1 << min(64, k * b.bits)) - 1)
        at = at[np.bitwise_count(part) <= int((k + 1) * b.budget)]
    ok[:] = False
    ok[at] = True
    return ok


def _meets_at(nodes: DataFrame, b: Blocks, rooted: bool, schema: str, made, together: int) -> DataFrame:
    """What made gives for the entries of some `together` nodes: (key, check, last, size, node[, root]), each as a row of 64-bit integers for
    each block and node; check are the 64 bits behind the block, last is the last word of the print."""
    names, rest = print_columns(b.words), ["size", "node", *["root"] * rooted]

    def entries(batches):
        own = [np.concatenate([x.column(c).to_numpy() for x in batches]) for c in (names[-1], *rest)]
        prints = np.stack([np.concatenate([x.column(c).to_numpy() for x in batches]) for c in names], axis=1).view(np.uint64)
        mask = np.uint64((1 << b.bits) - 1)
        out = np.empty((2 + len(own), b.count, len(prints)), dtype=np.int64)
        for k in range(b.count):
            out[0, k] = (_at(prints, k * b.bits) & mask).view(np.int64) | k << KEY_BITS
            out[1, k] = _at(prints, (k + 1) * b.bits).view(np.int64)
        out[2:] = np.stack(own)[:, None]
        return out.reshape(len(out), -1)

    def run(batches):
        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                held.append(whole.slice(at, together))
                n += held[-1].num_rows
                if n >= together:
                    yield from made(entries(held))
                    held, n = [], 0
        if held:
            yield from made(entries(held))

    return nodes.select(*rest, *names).mapInArrow(run, schema)


def _among(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which keys are among those of hot, which are in order."""
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def _entries(nodes: DataFrame, b: Blocks, rooted: bool, hot: np.ndarray) -> DataFrame:
    """(key, check, last, size, node[, root]): the entries of the keys in hot."""
    names = ["key", "check", "last", "size", "node", *["root"] * rooted]

    def made(t):
        t = t[:, _among(t[0], hot)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in t], names=names)

    return _meets_at(nodes, b, rooted, ", ".join(f"{c} long" for c in names), made, 2000)


def _counts(nodes: DataFrame, b: Blocks) -> DataFrame:
    """(key, count): how many of the nodes have a key."""

    def made(t):
        keys, n = np.unique(t[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return _meets_at(nodes, b, False, "key long, n long", made, -(-DEALT // b.count)).groupBy("key").agg(F.sum("n").alias("count"))


def _dealt(nodes: DataFrame, b: Blocks, rooted: bool, hot: np.ndarray) -> DataFrame:
    """(part, rows): the entries of the keys that are not in hot, those of a part of the keys together, as bytes: a row of theirs moves many."""
    bits = min(b.bits, PART_BITS)

    def made(t):
        if len(hot):
            t = t[:, ~_among(t[0], hot)]
        part = (t[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        rows = np.empty((len(part), len(t)), dtype=np.int64)
        for c in range(len(t)):
            rows[:, c] = t[c].take(order)
        n = np.bincount(part, minlength=1 << bits)
        parts = np.flatnonzero(n)
        ends = np.concatenate([[0], np.cumsum(n[parts])]) * (8 * len(t))
        whole = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])
        for at in range(0, len(parts), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(parts[at : at + 1000].astype(np.int32)), whole.slice(at, 1000)], names=["part", "rows"])

    return _meets_at(nodes, b, rooted, "part int, rows binary", made, -(-DEALT // b.count))


def _of_parts(batches, width: int, b: Blocks, found):
    """What found gives for the entries of batches (part, rows), which come by part, some 200,000 at a time and never part of a key."""

    def whole(held):
        rows = np.concatenate(held)
        key, size = rows[:, 0], rows[:, 3]
        wide = int(size.max()) + 1
        if (b.count << b.bits) * wide < 1 << 63:
            order = np.argsort((key >> KEY_BITS << b.bits | key & (1 << b.bits) - 1) * wide + size)
        else:
            order = np.lexsort((size, key))
        return found(np.ascontiguousarray(rows[order].T))

    held, n, last = [], 0, -1
    for batch in batches:
        part, rows = batch.column(0).to_numpy(), batch.column(1)
        ends = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
        data = np.frombuffer(rows.buffers()[2], dtype=np.uint8)
        begun = np.flatnonzero(np.append(part[:1] != last, part[1:] != part[:-1])).tolist()
        for lo, hi in zip([0, *begun], [*begun, len(part)], strict=True):
            if n >= 200_000 and (lo or begun[:1] == [0]):
                yield from whole(held)
                held, n = [], 0
            if lo < hi:
                held.append(data[ends[lo] : ends[hi]].copy().view(np.int64).reshape(-1, width))
                n += len(held[-1])
                last = part[lo]
    if n:
        yield from whole(held)


def _by_block(nodes: DataFrame, b: Blocks, found, max_run: int, sampled: int, rooted: bool = False) -> DataFrame:
    """(u, v): what found gives for the entries of each key. Keys with more than about max_run rows, found on one node in `sampled`,
    are dealt as pairs of parts, row by row: cells."""
    width = 5 + rooted
    part = _counts(nodes.where(F.pmod(F.xxhash64("node", F.lit(13)), F.lit(sampled)) == 0), b)
    large = cut(part.where(F.col("count") * sampled > max_run / 2).select(F.col("key").alias("hot"), F.ceil(F.col("count") * sampled / max_run).cast("int").alias("parts")), "large")
    hot = np.sort(large.select("hot").toArrow()["hot"].to_numpy())
    dealt = _dealt(nodes, b, rooted, hot).repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _of_parts(batches, width, b, found), "u long, v long")
    if not len(hot):
        return dealt.distinct()
    # each row meets every part of its key: cell (x, y) holds the parts x and y
    rows = _entries(nodes, b, rooted, hot)
    joined = rows.join(large, rows["key"] == large["hot"])
    joined = joined.withColumn("x", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = joined.select(*rows.columns, (F.least("x", "y") * F.col("parts") + F.greatest("x", "y")).cast("long").alias("cell")).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.union(cells.mapInArrow(lambda batches: by_key(batches, width, found), "u long, v long")).distinct()


def by_key(batches, width: int, found):
    """What found gives for the rows of batches, some 200,000 at a time and never part of a key (and
    cell, where there are more than `width` columns)."""
    held, n = [], 0
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
        n += b.num_rows
        if n < 200_000:
            continue
        t = np.concatenate(held, axis=1)
        last = t[0] == t[0, -1] if len(t) == width else (t[0] == t[0, -1]) & (t[width] == t[width, -1])
        yield from found(t[:, ~last])
        held, n = [t[:, last]], 0
    if held:
        yield from found(np.concatenate(held, axis=1))


class _Run:
    """Entries t, which come by key and cell, in the order of (key, cell, size), and the pairs among them that pass."""

    def __init__(self, t: np.ndarray, width: int, b: Blocks, least: float):
        turn = np.diff(t[0]) != 0
        if len(t) > width:
            turn |= np.diff(t[width]) != 0
        self.of = of = np.concatenate([[0], np.cumsum(turn)])  # the run of each row
        wide = int(t[3].max() / least if least else t[3].max()) + 2
        code = of * wide + t[3]
        self.t = t = t if (code[1:] >= code[:-1]).all() else t[:, np.argsort(code)]
        self.check, self.last, self.size, self.node = t[1].view(np.uint64), t[2].view(np.uint64), t[3], t[4]
        self.b, self.n, self.runs = b, t.shape[1], int(of[-1]) + 1
        # each row meets those behind it in its run whose sizes are in reach
        end = np.append(np.flatnonzero(np.diff(of)) + 1, self.n)[of]
        reach = np.searchsorted(of * wide + self.size, of * wide + np.floor(self.size / least + 1e-6).astype(np.int64), side="right") if least else end
        self.meets = np.maximum(reach - np.arange(self.n) - 1, 0)

    def _near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs that meet, the first in rows, without those whose 64 bits behind the block differ too much."""
        k, most = self.meets[rows], _budget(self.b)
        if len(rows) < k.max(initial=0):
            i = np.repeat(rows, k)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            near = np.flatnonzero(np.bitwise_count(self.check[i] ^ self.check[j]) <= most)
            return i[near], j[near]
        # all rows with the next of each, then all that have a second with that, and so on: those of most come first
        order = np.argsort(-k, kind="stable")
        rows, k = rows[order], k[order]
        left = np.searchsorted(-k, -np.arange(k[0] + 1 if len(k) else 0), side="right").tolist()
        own, found = self.check[rows], [(rows[:0], rows[:0])]
        for d in range(1, len(left)):
            n = left[d]
            near = (np.bitwise_count(self.check[d:].take(rows[:n]) ^ own[:n]) <= most).nonzero()[0]
            if len(near):
                i = rows[near]
                found.append((i, i + d))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        return i, j

    def pairs(self, wanted: Callable[[np.ndarray], np.ndarray]):
        """(u, v, differing bits): positions of pairs u < v that pass, of about a million that meet, or all of one row. wanted
        tells which of some rows are still looked at."""
        together = TOGETHER * 128 / self.b.bits * self.b.budget
        total, at = np.cumsum(self.meets), 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000, side="right")))
            rows = np.arange(at, to)
            rows = rows[self.meets[rows] > 0]
            rows = rows[wanted(rows)]
            i, j = self._near(rows)
            x = self.check[i] ^ self.check[j]
            ok = np.flatnonzero(_chain(x, self.b))
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(self.last[i] ^ self.last[j]).astype(np.int64) + np.bitwise_count(x[ok])
            keep = (self.node[i] != self.node[j]) & (apart <= together)
            yield i[keep], j[keep], apart[keep]
            at = to


def _spanned(r: _Run, b: Blocks, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (u, v) of a least spanning forest of the pairs that pass, and which rows have pairs beyond it."""
    most, hits = LIMIT * np.bincount(r.of, minlength=r.runs), np.zeros(r.runs, dtype=np.int64)
    found = []
    for u, v, _ in r.pairs(lambda rows: hits[r.of[rows]] <= most[r.of[rows]]):
        found.append((u, v))
        hits += np.bincount(r.of[u], minlength=r.runs)
    u, v = (np.concatenate(c) for c in zip(*found, strict=True))
    dense = hits > most
    keep = ~dense[r.of[u]] if len(u) else np.zeros(0, dtype=bool)
    u, v, more = forest(u[keep], v[keep], r.last, r.node)
    parts = [(u, v)]
    for k in np.flatnonzero(dense):
        lo, hi = np.searchsorted(r.of, [k, k + 1])
        x, y = spanning(r.check[lo:hi], r.last[lo:hi], r.size[lo:hi], b, least)
        parts.append((x + lo, y + lo))
        more[parts[-1][0]] = more[parts[-1][1]] = True
    return *(np.concatenate(c) for c in zip(*parts, strict=True)), more


def forest(u: np.ndarray, v: np.ndarray, last: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (u, v) of a least spanning forest by the difference of `last`, then by node, and which
    positions lie in a tree that left pairs out."""
    a, c = np.minimum(node[u], node[v]), np.maximum(node[u], node[v])
    order = np.lexsort((c, a, np.bitwise_count(last[u] ^ last[v])))
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    keep = []
    for k, x, y in zip(order.tolist(), u[order].tolist(), v[order].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            keep.append(k)
    more = np.zeros(len(last), dtype=bool)
    if len(keep) < len(u):
        left = np.ones(len(u), dtype=bool)
        left[keep] = False
        loops = {find(x) for x in u[left].tolist()}
        more[[i for i in root if find(i) in loops]] = True
    return u[keep], v[keep], more


def spanning(check: np.ndarray, last: np.ndarray, size: np.ndarray, b: Blocks, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a least spanning forest by the difference of `last` over the pairs that pass; Prim's steps,
    each over all rows that are left."""
    left, far = np.arange(len(check)), np.full(len(check), 255, dtype=np.uint8)
    by = np.full(len(check), -1)
    u, v = [], []
    while len(left):
        k = int(far.argmin())
        at = left[k]
        if by[k] >= 0:
            u.append(at)
            v.append(by[k])
        left, far, by = np.delete(left, k), np.delete(far, k), np.delete(by, k)
        d = np.bitwise_count(last[left] ^ last[at])
        near = np.flatnonzero((d < far) & (least * np.maximum(size[left], size[at]) <= np.minimum(size[left], size[at])))
        x = check[left[near]] ^ check[at]
        near = near[(d[near] + np.bitwise_count(x) <= TOGETHER * 128 / b.bits * b.budget) & _chain(x, b)]
        far[near] = d[near]
        by[near] = at
    return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)


def _named(r: _Run, u: np.ndarray, v: np.ndarray):
    a, c = r.node[u], r.node[v]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, c)), pa.array(np.minimum(a, c))], names=["u", "v"])


def meeting(nodes: DataFrame, b: Blocks, least: float, max_run: int = 20_000, sampled: int = 64) -> DataFrame:
    """(u, v), u >= v: pairs of nodes (node, size, p0, p1...) that meet on a block and pass the chain and whose
    smaller size is at least `least` of the larger, as a forest of each key. Rows with pairs beyond it are marked: (u, u)."""
    def found(t):
        if t.shape[1] > 1:
            r = _Run(t, 5, b, least)
            u, v, more = _spanned(r, b, least)
            mark = np.flatnonzero(more)
            if len(u):
                yield _named(r, np.concatenate([u, mark]), np.concatenate([v, mark]))

    return _by_block(nodes, b, found, max_run, sampled)


def untried(nodes: DataFrame, b: Blocks, least: float, most: int, max_run: int = 20_000, sampled: int = 64) -> DataFrame:
    """(u, v), u >= v: pairs of nodes (node, size, p0, p1..., root) of unequal roots that meet as in `meeting`: of those
    that a row has with rows of its key behind it the `most` of the least difference. The nodes of pairs beyond that are
    marked: (u, u)."""
    def found(t):
        if t.shape[1] < 2:
            return
        r = _Run(t, 6, b, least)
        more = np.zeros(r.n, dtype=bool)
        for u, v, apart in r.pairs(lambda rows: np.ones(len(rows), dtype=bool)):
            cross = r.t[5][u] != r.t[5][v]
            u, v, apart = u[cross], v[cross], apart[cross]
            order = np.lexsort((r.node[v], apart, u))
            u, v = u[order], v[order]
            first = np.arange(len(u)) - np.searchsorted(u, u) < most
            more[u[~first]] = more[v[~first]] = True
            if first.any():
                yield _named(r, u[first], v[first])
        mark = np.flatnonzero(more)
        if len(mark):
            yield _named(r, mark, mark)

    return _by_block(nodes, b, found, max_run, sampled, True)


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (u, v), also of nodes that had none."""
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    top = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.select("node", "root").union(top.select(F.col("root").alias("node"), "root")).distinct()
    return every.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def groups(nodes: DataFrame, b: Blocks, verify: Callable[[DataFrame], DataFrame], least: float = 0.0) -> DataFrame:
    """(node, root): each node that a verified pair joins to another, with the least node of its group.
    nodes: (node, size, p0, p1...), a written table; verify gives those of the pairs (u, v) that hold."""
    ship(nodes.sparkSession)
    found = cut(meeting(nodes, b, least), "links")
    links = found.where("u <> v")
    roots = components(verify(links))
    most, tried = AT_FIRST, links
    while not (marked := found.where("u = v").select(F.col("u").alias("node"))).isEmpty():
        named = nodes.join(marked, "node", "left_semi").join(roots, "node", "left").select("node", "size", *print_columns(b.words), F.coalesce("root", "node").alias("root"))
        found = cut(untried(cut(named, "open"), b, least, most), "untried")
        rest = cut(found.where("u <> v").join(tried, ["u", "v"], "left_anti"), "untried")
        if not rest.isEmpty():
            more = verify(rest)
            tried = tried.union(rest)
            if not more.isEmpty():
                roots = cut(joined_roots(roots, more), "roots")
        most *= GROWTH
    return roots
