"""Fuzzy line deduplication across documents.

Lines are normalised (ASCII lower case, digits alike, other ASCII signs and runs of blanks as one
blank). Equal normalised lines are one node, told apart by a 128-bit digest. Nodes whose SimHashes of distinct words
agree on a pigeonhole block and stay near on the ring behind it (see `blocks`) are candidates, and a link
counts if their edit similarity is at least `similarity`. Of each connected group the first occurrence
stays (least document id, then line); the others go. Lines of fewer than `min_words` words are never
touched.

Every candidate pair is verified before it joins anything, or lies in one group already by pairs that
were. Which near lines become candidates is a matter of chance: `recall` is the share wanted among lines
whose prints differ in a tenth of their bits (one word of twenty replaced).

Scale: lines travel as digests. For the edit check the documents are read again in place and only
candidate lines leave the scan, by a filter that is sent along while it is small; beyond that size all
lines take part in the join instead. Each text moves once, to the list of its lines that go, unless Spark
may broadcast that.

Cases: a null text stays null; empty lines stay; rows equal in id and text are one document and
keep the same lines; rows of equal id and other text, and rows of null id, count as one document
where they hold the first occurrence; ties go to the earlier line; very long lines are compared in
time proportional to their length times their difference in 64-bit words; an empty table gives
no rows; all columns stay, whatever their names, but one named dropped_lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.llm._shared import cut, few_tasks, fresh, ship
from ringspan.llm.blocks import bits_of, blocks_for, groups, print_columns, spread, wide_print  # noqa: F401

# Letters in lower case, digits as one, other signs as a blank; the line end and other bytes stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 10 else 48 if 48 <= b <= 57 else 32 for b in range(256))


def normalised(line: str) -> str:
    return " ".join(line.encode("utf-8", "replace").translate(_PLAIN).decode("utf-8").split())


#: Bytes of text that are normalised together, few enough for the processor's cache, and whose prints are made together.
TOGETHER_BYTES, PRINTED_BYTES = 150_000, 3_000_000
_PLACE = np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The share of each byte at each place of a word in the word's hash.
_TERMS = (_PLACE[:, None] * (np.arange(256, dtype=np.uint64) + np.uint64(1))).ravel()


class _Lines:
    """The lines of some texts, normalised together: `norms`, every line; `of`, the text of each; `at`, its place
    there; `words`, how many words it has."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts).translate(_PLAIN), dtype=np.uint8)
        ends = self.raw == 10
        solid = (self.raw != 32) & ~ends
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        self.start = np.flatnonzero(first)
        line = np.cumsum(ends, dtype=np.int32)[self.start]
        keep = solid | ends
        keep[self.start[1:][line[1:] == line[:-1]] - 1] = True  # one blank before each word that is not the first
        self.plain = self.raw[keep]
        self.norms = self.plain.tobytes().split(b"\n")
        self.words = np.bincount(line, minlength=len(self.norms))
        n = np.array([t.count(b"\n") + 1 for t in texts])
        self.of = np.repeat(np.arange(len(texts)), n)
        self.at = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        self._solid, self._first = solid, first

    def sizes(self) -> np.ndarray:
        """The characters of each line."""
        begun = np.concatenate([[0], np.cumsum((self.plain & 0xC0) != 0x80, dtype=np.int32)])
        ends = np.append(np.flatnonzero(self.plain == 10), len(self.plain))
        return np.diff(begun[ends].astype(np.int64), prepend=0) - np.append(0, np.ones(len(ends) - 1, dtype=np.int64))

    def hashes(self) -> np.ndarray:
        """A hash of each word, line by line: its bytes, each times a number of its place."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        letters = self.raw[self._solid]
        begun = np.flatnonzero(self._first[self._solid])
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(begun.astype(np.int32), np.diff(begun, append=len(letters)))
        sums = np.add.reduceat(_TERMS.take((place & np.int32(255)) << np.int32(8) | letters), begun)
        return (sums ^ (sums >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _together(texts):
    """(first, texts): runs of texts of about TOGETHER_BYTES, or one text; first is the number of the run's first."""
    part, held, first = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t.as_py())
        held += len(part[-1])
        if held > TOGETHER_BYTES:
            yield first, part
            part, held, first = [], 0, i + 1
    if part:
        yield first, part


def prints(hashes: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """SimHashes of `width` 64-bit words, one for each n of the hashes: of the distinct words of a line,
    since a word that every text has often would make lines alike that have little else in common."""
    out = np.zeros((len(n), width), dtype=np.uint64)
    start = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    size, at = n[order], 0
    while at < len(n):  # lines of about as many words come together, 64,000 words at a time
        least = int(size[at])
        if least > 255:
            k = least
            rows = order[at : at + 1]
        else:
            rows = order[at : min(int(np.searchsorted(size, min(255, least + least // 4 + 1), side="right")), at + 64000 // (2 * least + 1))]
            k = int(n[rows[-1]])
        own = n[rows][:, None]
        # places beyond a line hold the greatest number and come last
        part = np.sort(np.where(np.arange(k) < own, hashes.take(start[rows][:, None] + np.arange(k), mode="clip"), ~np.uint64(0)), axis=1) if k else np.zeros((len(rows), 0), dtype=np.uint64)
        again = np.arange(k) >= own
        again[:, 1:] |= part[:, 1:] == part[:, :-1]
        if k == 0:
            pass
        elif least < 256:
            made = spread(part.T.ravel(), width).reshape(k, len(rows), width)
            made[again.T] = 0
            out[rows] = _above(_counted(made), (k - again.sum(axis=1)) // 2)
        else:
            out[rows[0]] = wide_print(part[0][~again[0]], width)
        at += len(rows)
    return out


def _counted(words: np.ndarray) -> list[np.ndarray]:
    """How many of (k, ...) words have each bit, in binary: words of the ones, the twos and so on. Three words of a digit make one of it and one
    of the next."""
    digits, part = [], words
    while len(part):
        more = []
        while len(part) > 1:
            m = len(part) // 3
            if m:
                a, b, c = part[:m], part[m : 2 * m], part[2 * m : 3 * m]
                odd = a ^ b
                more.append(a & b | odd & c)
                part = np.concatenate([odd ^ c, part[3 * m :]])
            else:
                more.append(part[:1] & part[1:])
                part = part[:1] ^ part[1:]
        digits.append(part[0])
        part = np.concatenate(more) if more else part[:0]
    return digits


def _above(digits: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Which counts, as `_counted` gives them for each row, are over the number of the row."""
    over, level = np.zeros_like(digits[0]), np.full_like(digits[0], ~np.uint64(0))
    for p in range(max(len(digits), int(least.max(initial=0)).bit_length()) - 1, -1, -1):
        digit = digits[p] if p < len(digits) else np.zeros_like(over)
        wanted = np.where(least >> p & 1, ~np.uint64(0), np.uint64(0))[:, None]
        over |= level & digit & ~wanted
        level &= ~(digit ^ wanted)
    return over


def _alike(a, b) -> int:
    """The length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edit_distance(a, b, most: int) -> int:
    """The Levenshtein distance of strings or lists, or more than `most` if it is more; bit-parallel."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    k = _alike(a, b)
    a, b = a[k:], b[k:]
    e = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - e], b[: len(b) - e]
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, d = full, 0, len(a)
    check = max(64, len(b) // 4)
    for j, c in enumerate(b):
        if j == check:  # can any place of this column still come to an end within reach?
            check = j + max(64, len(b) // 8)
            if _least(pv, mv, len(a), j, len(b)) > most:
                return most + 1
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        d += bool(ph & top) - bool(mh & top)
        if d - (len(b) - 1 - j) > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return d


def _least(pv: int, mv: int, m: int, j: int, n: int) -> int:
    """The least distance that the column after j letters can lead to: its values, and what the rest
    must cost for its length alone."""
    size = (m + 7) // 8
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), dtype=np.uint8), bitorder="little", count=m).astype(np.int32) for x in (pv, mv))
    column = j + np.concatenate([[0], np.cumsum(up - down)])
    return int((column + np.abs((m - np.arange(m + 1)) - (n - j))).min())


#: How many words of either line are passed over, eight in all at most: few first, and as many of one as of the other.
_NEAREST = [(a, skip - a) for skip in range(1, 9) for a in sorted(range(skip + 1), key=lambda a: abs(2 * a - skip))]


def _word_by_word(x: list[str], y: list[str], most: int) -> bool:
    """Whether walking both lines and replacing what lies between words they share costs `most` letters at
    most, which their distance then does as well. False says nothing."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for a, c in _NEAREST:  # the nearest words that agree again
            to, at = i + a, j + c
            if to < n and at < m and x[to] == y[at]:
                break
        else:
            break
        cost += max(sum(map(len, x[i:to])) + a, sum(map(len, y[j:at])) + c)
        if cost > most:
            return False
        i, j = to, at
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


def _place_by_place(x: list[str], y: list[str], most: int) -> bool:
    """Whether lines of as many words are near if each word stays in its place. False says nothing."""
    return len(x) == len(y) and sum([max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q]) <= most


def similar(a: str, b: str, similarity: float) -> bool:
    return bool(_similar([a], [b], similarity)[0])


#: Lines up to so many letters are measured side by side, unless they are fewer than the second; longer ones each by itself.
SIDE_LETTERS, LEAST_PAIRS = 1 << 15, 3
#: Pairs that are measured at once at most, entries of each of their tables, and bytes of lines that are held for that.
SIDE_PAIRS, SIDE_ENTRIES, HELD_BYTES = 512, 1 << 22, 16_000_000


def _similar(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """Which pairs of lines are as similar as asked for. Most are seen by their words; what is left is measured."""
    ok, left = np.zeros(len(a), dtype=bool), []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        most = int((1 - similarity) * max(len(p), len(q)) + 1e-9)
        if abs(len(p) - len(q)) > most:
            continue
        x, y = p.split(" "), q.split(" ")
        if _place_by_place(x, y, most) or _word_by_word(x, y, most):
            ok[i] = True
        elif max(len(p), len(q)) <= SIDE_LETTERS:
            left.append((i, most, *_trimmed(p, q)))
        else:
            ok[i] = edit_distance(p, q, most) <= most
    for part in _of_a_size(left):
        at, most, p, q = zip(*part, strict=True)
        found = edit_distances(p, q) if len(part) >= LEAST_PAIRS else [edit_distance(y, x, d) for d, x, y in zip(most, p, q, strict=True)]
        ok[list(at)] = np.array(found) <= np.array(most)
    return ok


def _of_a_size(left: list[tuple]):
    """Rows (number, most, a, b) in parts: strings of like lengths, few enough for their tables."""
    part, entries = [], 0
    for r in sorted(left, key=lambda r: len(r[3])):
        letters = len(set(r[2]))
        if part and (len(part) == SIDE_PAIRS or len(r[3]) > (1.3 if len(part) > 63 else 3) * len(part[0][3]) + 64 or (entries + letters) * (len(r[3]) // 64 + 1) > SIDE_ENTRIES or (len(part) + 1) * len(r[3]) > SIDE_ENTRIES):
            yield part
            part, entries = [], 0
        part.append(r)
        entries += letters
    if part:
        yield part


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Two strings without their common ends, the shorter first."""
    k = _alike(a, b)
    a, b = a[k:], b[k:]
    e = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - e], b[: len(b) - e]
    return (a, b) if len(a) <= len(b) else (b, a)


def _letters(strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, number of the string, place) of all strings, end to end."""
    n = np.array([len(s) for s in strings])
    letters = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return letters, np.repeat(np.arange(len(n)), n), np.arange(len(letters)) - np.repeat(np.cumsum(n) - n, n)


def edit_distances(a, b) -> np.ndarray:
    """The Levenshtein distances of pairs of strings, bit-parallel for all pairs side by side: step t takes each word of 64 letters
    of each a one letter further, the w-th to letter t - w of its b, so that it has what the word before it left a step ago."""
    n, one = len(a), np.uint64(1)
    size_a, size_b = (np.array([len(s) for s in x]) for x in (a, b))
    words, longest = max(1, -(-int(size_a.max(initial=0)) // 64)), int(size_b.max(initial=0))
    letter, pair, place = _letters(a)
    known, rank = np.unique(pair << 21 | letter, return_inverse=True)
    table = np.zeros((len(known) + 1, words), dtype=np.uint64)  # where each letter of each a is; the last row for other letters
    np.bitwise_or.at(table, (rank, place >> 6), one << (place & 63).astype(np.uint64))
    letter, pair, place = _letters(b)
    key = pair << 21 | letter
    rank = np.searchsorted(known, key)
    rank[np.append(known, -1)[rank] != key] = len(known)
    other = np.full((longest + 2 * words, n), len(known) * words)
    other[place + words, pair] = rank * words
    nth = np.arange(words)[:, None]
    inside = np.clip(size_a - 64 * nth, 0, 64).astype(np.uint64)  # letters of each word
    inside = np.where(inside == 64, ~np.uint64(0), (one << (inside & np.uint64(63))) - one)
    done = (size_b - 1 + nth).ravel()
    order = np.argsort(done, kind="stable")
    bound = np.searchsorted(done[order], np.arange(longest + words + 1))
    out = np.where(size_b > 0, 0, np.bitwise_count(inside).astype(np.int64))  # the deltas down the last column
    pv, mv = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    up, down = np.ones((words + 1, n), dtype=np.uint64), np.zeros((words + 1, n), dtype=np.uint64)
    flat = table.ravel()
    for t in range(longest + words - 1):
        k = min(words, t + 1)
        p, m, hp, hm = pv[:k], mv[:k], up[:k], down[:k]
        eq = flat.take(other[t + words : t + words - k : -1] + nth[:k])
        xv = eq | m
        eq |= hm
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = m | ~(xh | p), p & xh
        next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
        ph = ph << one | hp
        pv[:k] = mh << one | hm | ~(xv | ph)
        mv[:k] = ph & xv
        up[1 : k + 1], down[1 : k + 1] = next_up, next_down
        if bound[t] < bound[t + 1]:
            at = order[bound[t] : bound[t + 1]]
            w, c = at // n, at % n
            here = size_b[c] > 0
            w, c = w[here], c[here]
            out[w, c] = np.bitwise_count(pv[w, c] & inside[w, c]).astype(np.int64) - np.bitwise_count(mv[w, c] & inside[w, c])
    return size_b + out.sum(axis=0)


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int, width: int) -> DataFrame:
    """(id, thash, line, again, d1, d2, size, p0, p1...): each line of enough words, by document and place;
    d1 and d2 are its digest, p0 and so on its print, again is true if the document has an equal line before it; size is the
    normalised length."""
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("binary").alias("text"))
    out = T.StructType([src.schema["id"], src.schema["thash"], T.StructField("line", T.IntegerType()), T.StructField("again", T.BooleanType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("size", T.LongType()), *(T.StructField(c, T.LongType()) for c in print_columns(width))])

    def run(batches):
        from xxhash import xxh3_128_digest

        def batch(b, parts):
            row, line, again, digests, sizes, words, hashes = ([x for p in parts for x in p[k]] if k in (2, 3) else np.concatenate([p[k] for p in parts]) for k in range(7))
            made = prints(hashes, words, width)
            at, d = pa.array(row), _halves(digests)
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(line.astype(np.int32)), pa.array(again, pa.bool_()), pa.array(d[0]), pa.array(d[1]), pa.array(sizes), *(pa.array(np.ascontiguousarray(made[:, k]).view(np.int64)) for k in range(width))], names=out.names)

        for b in batches:
            parts, held = [], 0
            for low, texts in _together(b.column(2)):
                lines = _Lines(texts)
                keep = np.flatnonzero(lines.words >= min_words)
                digests = [xxh3_128_digest(lines.norms[i]) for i in keep.tolist()]
                again, seen, text = [], set(), -1
                for i, d in zip(lines.of[keep].tolist(), digests, strict=True):
                    if i != text:
                        seen, text = set(), i
                    again.append(d in seen)
                    seen.add(d)
                wanted = np.repeat(lines.words >= min_words, lines.words)
                parts.append((low + lines.of[keep], lines.at[keep], again, digests, lines.sizes()[keep], lines.words[keep], lines.hashes()[wanted]))
                held += len(lines.raw)
                if held > PRINTED_BYTES:
                    yield batch(b, parts)
                    parts, held = [], 0
            if parts:
                yield batch(b, parts)

    return src.mapInArrow(run, out)


def _halves(digests: list[bytes]) -> np.ndarray:
    """The two 64-bit halves of each digest."""
    return np.ascontiguousarray(np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2).T)


def verified(links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """links with `ok`: whether the edit similarity of the two lines suffices."""
    src = links.join(texts.select(F.col("node").alias("u"), F.col("norm").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("norm").alias("b")), "v").select("u", "v", "a", "b")

    def judged(held):
        t = pa.Table.from_batches(held).combine_chunks()
        ok = _similar(t.column(2).to_pylist(), t.column(3).to_pylist(), similarity)
        yield from pa.table({"u": t.column(0), "v": t.column(1), "ok": pa.array(ok)}).to_batches()

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > HELD_BYTES:
                yield from judged(held)
                held, size = [], 0
        if held:
            yield from judged(held)

    return src.mapInArrow(run, "u long, v long, ok boolean")


#: Lines that the filter of candidate lines and their documents may hold: 16 bits a line, 32 MB at most. Beyond, there is no filter.
FILTER_LINES = 1 << 24


def bloom(keys: DataFrame, n: int) -> np.ndarray | None:
    """A Bloom filter of n 64-bit keys, put together on the executors; None for too many."""
    if n > FILTER_LINES:
        return None
    words = 1 << max(10, (n - 1).bit_length() - 2) if n else 1024
    at = F.array(F.col("key").bitwiseAND(F.lit(64 * words - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(64 * words - 1)))
    bits = keys.select(F.explode(at).alias("b")).select(F.shiftrightunsigned("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))
    found = bits.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[found["w"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return out


def _passes(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    d, mask, hit = keys.view(np.uint64), np.uint64(64 * len(have) - 1), np.ones(len(keys), dtype=bool)
    for p in (d & mask, d >> np.uint64(32) & mask):
        hit &= (have[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def norms_of(docs: DataFrame, ends: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(node, norm): the normalised text of each of the ends (node, d1, d2, first), more than once perhaps.
    Documents are read again in place, those that the filter lets through by their ids; a line leaves the scan where it lets its
    digest and the id of its first document through, and a join drops those that passed by chance."""
    first = F.xxhash64("first")
    have = bloom(ends.select(F.explode(F.array(F.col("d1").bitwiseXOR(first), first)).alias("key")), ends.count())
    sent = docs.sparkSession.sparkContext.broadcast(have)
    src = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        from xxhash import xxh3_128_digest

        have, seen = sent.value, set()

        for b in batches:
            if have is not None:
                b = b.take(pa.array(np.flatnonzero(_passes(have, b.column(0).to_numpy()))))
            ids = b.column(0).to_numpy()
            for low, texts in _together(b.column(1)):
                lines = _Lines(texts)
                whole = np.flatnonzero(lines.words >= min_words)
                if not len(whole):
                    continue
                digests = [xxh3_128_digest(lines.norms[i]) for i in whole.tolist()]
                d, keep = _halves(digests), []
                for i in range(len(whole)) if have is None else np.flatnonzero(_passes(have, d[0] ^ ids[low + lines.of[whole]])).tolist():
                    if digests[i] not in seen:
                        seen.add(digests[i])
                        keep.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(d[0][keep]), pa.array(d[1][keep]), pa.array([lines.norms[i].decode("utf-8", "replace") for i in whole[keep].tolist()], pa.string())], names=["d1", "d2", "norm"])

    found = src.mapInArrow(run, "d1 long, d2 long, norm string").join(ends.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "norm")
    return found if have is not None else found.dropDuplicates(["node"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """docs with the lines that go taken out, and `dropped_lines`: their numbers, from 0."""
    spark = docs.sparkSession
    ship(spark)
    b = blocks_for(8 * docs.count(), 0.1, recall, 0.2)
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("d1", "d2", *print_columns(b.words))}  # hardly a value comes twice
    lines = cut(lines_of(docs, id_col, text_col, min_words, b.words), "lines", plain)
    same = lines.where("not again").groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), *[F.min(c).alias(c) for c in print_columns(b.words)])
    nodes = cut(same.withColumn("node", F.monotonically_increasing_id()), "line_nodes", plain)

    ends = norms = None

    def verify(links):
        nonlocal ends, norms
        if norms is None:  # pairs that are left untried are of lines that the first pairs have
            ends = ends_of(links)
            norms = cut(norms_of(docs, ends, id_col, text_col, min_words), "line_norms")
        return cut(verified(links, norms, similarity).where("ok").select("u", "v"), "line_links")

    def ends_of(links):
        named = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        with few_tasks(spark):
            return cut(nodes.select("node", "d1", "d2", "first").join(named, "node", "left_semi"), "line_ends")

    roots = groups(nodes.select("node", "size", *print_columns(b.words)), b, verify, similarity)
    fuzzy = ends.join(roots, "node").select("d1", "d2", "root", "first")
    group = fuzzy.groupBy("root").agg(F.min("first").alias("keep"))
    # a group of one node that one document holds has nothing to drop but its own repeats
    alone = nodes.where("n > 1").join(roots, "node", "left_anti").select("d1", "d2", F.col("node").alias("root"), F.col("first").alias("keep"))
    shared = fuzzy.join(group, "root").select("d1", "d2", "root", "keep").union(alone)
    with few_tasks(spark):
        held = cut(shared, "line_groups")
    # one row of `held` for each key: its side is held, and lines need no sorting
    placed = lines.join(held.hint("shuffle_hash"), ["d1", "d2"], "left").where("again or root is not null")
    here = cut(placed.select("id", "thash", "line", "root", "again", (F.col("root").isNotNull() & F.col("id").eqNullSafe(F.col("keep"))).alias("home")), "line_places")
    first = here.where("home").groupBy("root").agg(F.min("line").alias("first_line"))
    gone = here.where("again or not home").select("id", "thash", "line").union(here.where("home and not again").join(first, "root").where("line <> first_line").select("id", "thash", "line"))
    own, own_hash = fresh(docs, "id", "thash")
    gone = cut(gone.groupBy("id", "thash").agg(F.sort_array(F.collect_set("line")).alias("dropped_lines")).withColumnsRenamed({"id": own, "thash": own_hash}), "lines_gone")
    kept = [f for f in docs.schema.fields if f.name.lower() != "dropped_lines"]
    src = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    # one row of `gone` for each key: its side is small enough to be held, and texts need no sorting
    joined = src.join(gone.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(own_hash)), "left").drop(own, own_hash)
    drop = F.coalesce("dropped_lines", F.array().cast("array<int>"))

    def left(lines):
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: lines[i]), "\n")

    text = F.col(f"`{text_col}`")
    cleaned = F.when(F.size(drop) > 0, F.transform(F.array(F.split(text, "\n")), left)[0]).otherwise(text)
    return joined.select(*[cleaned.alias(f.name) if f.name == text_col else F.col(f"`{f.name}`") for f in kept], drop.alias("dropped_lines"))
