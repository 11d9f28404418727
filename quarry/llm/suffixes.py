"""Exact substring deduplication over bytes by a hash-compared suffix sort.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller id. Strings that
can repeat are found first, so that only these are sorted:

1. The anchor of a string is its 24-byte gram of smallest hash (the leftmost of equals). Equal strings have equal
   anchors at equal places. A chunk asks which of its anchors occur in other documents.
2. Neighbouring strings with the same anchor make a run. Equal runs meet by a hash, with their bytes, which are compared:
   of equal runs all but the one of the smallest id are covered whole. A run that is its kind's first and whose anchor
   has runs of other kinds (told by 64 bits of a hash) is still open.
3. The open runs' texts meet by anchor and their suffixes are sorted by a mergesort. Two suffixes are compared by
   binary search for their longest common extension over prefix polynomial hashes, so in a logarithmic number of
   steps. Neighbours that agree over 50 bytes are verified byte by byte; a false match sorts anew under another hash.
   Each class of equal strings then knows its smallest id. An anchor with over ``CROWDED`` kinds of runs (the edge of
   a passage that a third of all rows share) is too much for one task: its strings are dealt by a hash of the whole
   string, each with its bytes, and sorted and verified there alike.

Null texts are empty. A null id comes before all others; rows that share an id are one document. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as pk
from .textnum import BASES, U, mixed, polynomials

WINDOW, GRAM = 50, 24
WITHIN = WINDOW - GRAM + 1  # grams in a string
SLICE = 1 << 16  # bytes of text whose runs are found at a time
_T = np.random.default_rng(77).integers(1, 1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)


class Runs:
    """The runs of a chunk: first and last start of their strings, the place and hash of their anchor, their row."""

    def __init__(self, c: pk.Chunk):
        parts = []
        lengths = np.diff(c.offsets)
        i = 0
        while i < len(lengths):  # some rows at a time, which a core's cache holds, a long row alone
            j = max(i + 1, int(np.searchsorted(c.offsets, c.offsets[i] + SLICE, "right")) - 1)
            parts.append(self._some(c, i, j))
            i = j
        self.lo, self.hi, self.anchor, self.gram, self.row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        self.ids = c.ids[self.row]

    @staticmethod
    def _some(c: pk.Chunk, i: int, j: int) -> tuple[np.ndarray, ...]:
        base = int(c.offsets[i])
        data = c.data[base : int(c.offsets[j])]
        if len(data) < WINDOW:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none
        grams = polynomials(_T.take(data), GRAM)
        # An order needs half a mix; anchors alone are mixed wholly.
        low = grams >> U(32)
        low ^= grams
        low *= BASES[1]
        low &= U(0xFFFFFFFF00000000)
        low |= np.arange(len(low), dtype=np.uint64)
        width = 1
        while width * 2 <= WITHIN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        n = len(data) - WINDOW + 1
        low = np.minimum(low[:n], low[WITHIN - width :][:n])
        # A run ends where its anchor does, where its row does, and where strings would leave the row.
        ends = c.offsets[i + 1 : j + 1] - base
        cut = np.ones(n, bool)
        np.not_equal(low[1:], low[:-1], out=cut[1:])
        cut[ends[ends < n]] = True
        out = ends - WINDOW + 1
        cut[out[(out > 0) & (out < n)]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n) - 1
        row = np.searchsorted(ends, first, "right")
        good = first + WINDOW <= ends[row]
        first, last, row = first[good], last[good], row[good] + i
        anchor = (low[first] & U(0xFFFFFFFF)).astype(np.int64)
        return first + base, last + base, anchor + base, mixed(grams[anchor]), row

    def texts(self, c: pk.Chunk, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some runs, one after another, and their lengths."""
        lens = self.hi[some] - self.lo[some] + WINDOW
        within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        return c.data[np.repeat(self.lo[some], lens) + within], lens


def _anchors(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams, which of them each run has, and whether two documents of the chunk have it."""
    order = np.argsort(runs.gram)
    gram = runs.gram[order]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    which = np.zeros(len(gram), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
    ids = runs.ids[order]
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    return gram[first], which, several.astype(np.uint8)


def run_hashes(values: np.ndarray, lens: np.ndarray, k: int) -> np.ndarray:
    """A hash of each of several runs of values that stand one after another; ``k`` picks one of two bases."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    power = np.cumprod(np.concatenate(([U(1)], np.full(int(lens.max()), BASES[k]))))
    within = np.arange(len(values)) - np.repeat(first, lens)
    return mixed(np.add.reduceat(values * power[within], first) + lens.astype(np.uint64) * BASES[1 - k])


class Kinds:
    """The runs whose anchor occurs elsewhere, in the order of (gram, text's hashes, id)."""

    def __init__(self, c: pk.Chunk, runs: Runs, answers: dict, buckets: int):
        h, which, _ = _anchors(runs)
        at = np.flatnonzero(pk.answered(c.number, h, answers, 1, buckets)[which]) if len(h) else np.zeros(0, np.int64)
        data, lens = runs.texts(c, at)
        # Where the anchor stands in the run is part of what it is.
        a = mixed(run_hashes(_T[data], lens, 0) + (runs.anchor - runs.lo)[at].astype(np.uint64) * U(0x9E3779B97F4A7C15)) if len(at) else np.zeros(0, np.uint64)
        b = run_hashes(_T[data], lens, 1)
        order = np.lexsort((runs.ids[at], b, a, runs.gram[at]))
        self.at, self.a, self.b = at[order], a[order], b[order]
        self.gram, self.ids = runs.gram[self.at], runs.ids[self.at]
        n = len(self.at)
        self.opens = np.ones(n, bool)
        if n:
            self.opens[1:] = (self.gram[1:] != self.gram[:-1]) | (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
            # Bytes have the last word. Runs that they part are compared again where their kinds meet.
            lo, lens = runs.lo[self.at], runs.hi[self.at] - runs.lo[self.at] + WINDOW
            offset, near = runs.anchor[self.at] - lo, np.flatnonzero(~self.opens)
            self.opens[near] = (lens[near] != lens[near - 1]) | (offset[near] != offset[near - 1])
            near = near[~self.opens[near]]
            self.opens[near] = ~pk.same_bytes(c.data, lo[near - 1], lo[near], lens[near])
        self.group = np.cumsum(self.opens) - 1
        self.first_id = self.ids[self.opens]
        new = np.concatenate(([True], self.gram[1:] != self.gram[:-1])) if n else np.zeros(0, bool)
        self.gram_first = np.flatnonzero(new)
        self.grams = self.gram[self.gram_first]
        self.gram_group = np.cumsum(new) - 1
        self.kinds_here = np.add.reduceat(self.opens.astype(np.int64), self.gram_first) if n else np.zeros(0, np.int64)

    def by_kind(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pk.dealt_to((self.a[self.opens] % U(buckets)).astype(np.int64))

    def by_gram(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pk.dealt_to((self.grams % U(buckets)).astype(np.int64))


class Open:
    """The runs that are still open: those whose strings are sorted, and the strings of those in a crowd."""

    def __init__(self, c: pk.Chunk, runs: Runs, k: Kinds, answers: dict, buckets: int):
        self.earlier = pk.read_answers(k.by_kind(buckets), answers, 2, np.uint8)
        gram = pk.read_answers(k.by_gram(buckets), answers, 2, np.uint8, buckets)
        open_ = k.opens & (self.earlier[k.group] == 0) if len(k.at) else np.zeros(0, bool)
        of_gram = gram[k.gram_group] if len(k.at) else np.zeros(0, np.uint8)
        self.some, crowd = np.flatnonzero(open_ & (of_gram == SEVERAL)), np.flatnonzero(open_ & (of_gram == CROWD))
        self.all = np.concatenate((self.some, crowd))
        self.dealt = pk.dealt_to((k.gram[self.some] % U(buckets)).astype(np.int64))
        lo, n = runs.lo[k.at[crowd]], runs.hi[k.at[crowd]] - runs.lo[k.at[crowd]] + 1
        self.run = np.repeat(np.arange(len(crowd)), n)
        self.within = np.arange(len(self.run)) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(lo, n) + self.within
        strings = c.data[start[:, None] + np.arange(WINDOW)] if len(start) else np.zeros((0, WINDOW), np.uint8)
        ids = k.ids[crowd][self.run] if len(crowd) else np.zeros(0, np.int64)
        # Equal strings of the chunk are one, the one of its smallest id.
        _, kind = np.unique(np.ascontiguousarray(strings).view(f"V{WINDOW}").ravel(), return_inverse=True)
        self.order = np.lexsort((ids, kind))
        ids, kind = ids[self.order], kind[self.order]
        first = np.concatenate(([True], kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, bool)
        self.strings, self.ids, self.string = strings[self.order[first]], ids[first], np.cumsum(first) - 1
        self.a = run_hashes(_T[self.strings.reshape(-1)], np.full(len(self.strings), WINDOW), 0)
        self.later_here = ids > self.ids[self.string] if len(ids) else first
        self.strings_dealt = pk.dealt_to((self.a % U(buckets)).astype(np.int64))

    def bits(self, answers: dict, buckets: int) -> np.ndarray:
        """A bit for each string of the open runs, in the order of ``all``."""
        sorted_ = pk.read_answers(self.dealt, answers, 3, np.uint32)
        later = self.later_here | (pk.read_answers(self.strings_dealt, answers, 3, np.uint32, buckets)[self.string] > 0) if len(self.run) else self.later_here
        crowd = np.zeros(len(self.all) - len(self.some), np.uint32)
        np.bitwise_or.at(crowd, self.run[self.order], later.astype(np.uint32) << self.within[self.order].astype(np.uint32))
        return np.concatenate((sorted_, crowd))


def _shared(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    marks = [np.frombuffer(r["hash"], np.uint32) for r in rows]
    _, which, count = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    several = np.bincount(which, np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows]), len(count)) > 0
    return [len(x) for x in marks], ((count > 1) | several)[which]


def _kinds_asked(c: pk.Chunk, runs: Runs, k: Kinds, buckets: int) -> pa.RecordBatch:
    """Two questions: kinds, dealt by their hashes, with the smallest id here; and grams, with one of their kinds and
    how many this chunk has. So an anchor that is everywhere costs a few bytes a chunk, and its kinds spread."""
    arrays: list[list] = [[] for _ in range(7)]
    o = k.at[k.opens]
    data, lens = runs.texts(c, o)
    begin = np.cumsum(lens) - lens
    order, which, ends = k.by_kind(buckets)
    columns = (k.a[k.opens], k.first_id, lens.astype(np.uint8), (runs.anchor - runs.lo)[o].astype(np.uint8))
    arrays[0] += which.tolist()
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        some = order[i:j]
        for out, v in zip((arrays[1], arrays[3], arrays[4], arrays[5]), columns, strict=True):
            out.append(v[some].tobytes())
        arrays[2].append(None)
        arrays[6].append(pk.squeezed(data[pk.places(begin[some], lens[some])]))
    order, which, ends = k.by_gram(buckets)
    columns = (pk.fingerprint(k.grams, buckets), k.a[k.gram_first] ^ k.b[k.gram_first], np.minimum(k.kinds_here, 65535).astype(np.uint16))
    arrays[0] += (which + buckets).tolist()
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        for out, v in zip(arrays[1:4], columns, strict=True):
            out.append(v[order[i:j]].tobytes())
        for out in arrays[4:]:
            out.append(None)
    return pk.asked_blobs(c.number, arrays, ["a", "b", "ids", "lens", "offset", "text"])


#: Answers about a gram: all its runs are of one kind; there are several kinds; more than one task should sort.
ONE, SEVERAL, CROWD = 0, 1, 2
#: From so many kinds on, the strings of a gram's open runs are dealt by a hash of the whole string.
CROWDED = 4096


def _earlier(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    """For kinds with the smallest id of a chunk: whether another chunk has a smaller one."""
    a, ids, lens, offset = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("a", np.uint64), ("ids", np.int64), ("lens", np.uint8), ("offset", np.uint8)))
    data = np.concatenate([np.frombuffer(pk.loose(r["text"]), np.uint8) for r in rows])
    kind = pk.classes([a, offset], data, lens.astype(np.int64))
    least = np.full(int(kind.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    return [len(r["lens"]) for r in rows], (ids > least[kind]).astype(np.uint8)


def grams_decided(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    """For anchors, each with a kind of a chunk's runs and how many it has: if there is one kind, several, or a crowd."""
    marks = [np.frombuffer(r["a"], np.uint32) for r in rows]
    kind = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in rows])
    here = np.concatenate([np.frombuffer(r["ids"], np.uint16) for r in rows]).astype(np.int64)
    _, which = np.unique(np.concatenate(marks), return_inverse=True)
    n = int(which.max(initial=-1)) + 1
    least, most = np.full(n, U((1 << 64) - 1)), np.zeros(n, np.uint64)
    np.minimum.at(least, which, kind)
    np.maximum.at(most, which, kind)
    several = (least != most) | (np.bincount(which, here > 1, n) > 0)
    crowd = several & (np.bincount(which, here, n) > CROWDED)
    return [len(x) for x in marks], np.where(crowd, CROWD, np.where(several, SEVERAL, ONE)).astype(np.uint8)[which]


# --- the suffix sort ---------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of a text, compared over their first 50 bytes by prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, seed: int):
        self.text = np.concatenate((text, np.zeros(1, np.uint8)))
        base = int(BASES[0]) + 2 * seed
        inverse = pow(base, -1, 1 << 64)
        n = len(text) + 1
        table = mixed(_T + U(seed))
        power = np.cumprod(np.concatenate(([U(1)], np.full(n, U(base % (1 << 64))))))
        self.back = np.cumprod(np.concatenate(([U(1)], np.full(n, U(inverse)))))
        self.sums = np.concatenate(([U(0)], np.cumsum(table[self.text] * power[:n])))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length, up to 50, of the longest common extension of suffixes ``i`` and ``j``."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), WINDOW)
        si, sj, bi, bj = self.sums[i], self.sums[j], self.back[i], self.back[j]
        while True:
            middle = (low + high + 1) >> 1
            if not (low < high).any():
                return low
            same = (self.sums[i + middle] - si) * bi == (self.sums[j + middle] - sj) * bj
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix ``i`` comes before suffix ``j``."""
        e = self.extension(i, j)
        return (e < WINDOW) & (self.text[np.minimum(i + e, len(self.text) - 1)] < self.text[np.minimum(j + e, len(self.text) - 1)])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A stable mergesort of suffixes ``at`` within their groups (ascending numbers), all merges of a level at once."""
        at = at.copy()
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(at)))
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        width = 1
        while width < size.max(initial=0):
            live = np.flatnonzero(end - begin > width)
            place = live - begin[live]
            run = place // width
            left = run % 2 == 0
            low = begin[live] + (run ^ 1) * width
            low, high = np.minimum(low, end[live]), np.minimum(low + width, end[live])
            start = low.copy()
            me = at[live]
            while True:  # how many of the other run come before
                some = np.flatnonzero(low < high)
                if not len(some):
                    break
                middle = (low[some] + high[some]) >> 1
                other = at[middle]
                before = np.zeros(len(some), bool)
                l = left[some]  # noqa: E741
                before[l] = self.less(other[l], me[some[l]])
                before[~l] = ~self.less(me[some[~l]], other[~l])
                low[some[before]] = middle[before] + 1
                high[some[~before]] = middle[~before]
            to = begin[live] + (run // 2) * 2 * width + place % width + (low - start)
            at[to] = me
            width *= 2
        return at


def equal_strings(text: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` sorted within groups, and the number of the class of equal strings of 50 bytes of each."""
    span = np.arange(WINDOW)
    for seed in range(1, 1 << 20, 2):
        s = Suffixes(text, seed)
        order = s.sort(at, group)
        same = np.zeros(len(order), bool)
        near = np.flatnonzero(group[1:] == group[:-1]) + 1
        same[near] = s.extension(order[near - 1], order[near]) == WINDOW
        good = True
        for i in range(0, len(order), 1 << 16):
            some = np.flatnonzero(same[i : i + (1 << 16)]) + i
            good = good and bool((text[order[some][:, None] + span] == text[order[some - 1][:, None] + span]).all())
        if good:
            return order, np.cumsum(~same) - 1
    raise RuntimeError("no hash without collisions")


def _open_decided(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    """For each open run a bit a string: whether it also starts in an earlier document."""
    text = np.concatenate([np.frombuffer(pk.loose(r["text"]), np.uint8) for r in rows])
    gram, lens, place, ids = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("gram", np.uint64), ("lens", np.uint8), ("place", np.uint8), ("ids", np.int64)))
    lengths = [len(r["lens"]) for r in rows]
    lens = lens.astype(np.int64)
    strings = lens - WINDOW + 1
    run = np.repeat(np.arange(len(lens)), strings)
    within = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = (np.cumsum(lens) - lens)[run] + within
    # Equal strings have the same anchor at the same place.
    _, group = np.unique(mixed(gram[run] + (place[run] - within).astype(np.uint64)), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    order, kind = equal_strings(text, at[by_group], group[by_group])
    run_of = np.zeros(len(text) + 1, np.int64)
    run_of[at] = run
    owner = ids[run_of[order]]
    least = np.full(int(kind[-1]) + 1 if len(kind) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, owner)
    later = np.zeros(len(text) + 1, bool)
    later[order] = owner > least[kind]
    bits = np.zeros(len(lens), np.uint32)
    np.bitwise_or.at(bits, run, later[at].astype(np.uint32) << within.astype(np.uint32))
    return lengths, bits


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``with_bytes`` also ``kept_bytes``."""
    packed = pk.pack(docs, id_col, text_col)
    size = packed.agg(F.sum("size")).first()[0] or 0
    buckets = pk.bucket_count(docs.sparkSession, size // 14)

    def anchors(c: pk.Chunk, _: dict) -> pa.RecordBatch:
        h, _, flags = _anchors(Runs(c))
        return pk.asked(c.number, h, {"hash": pk.fingerprint(h, buckets), "flags": flags}, buckets)

    def kinds(c: pk.Chunk, answers: dict) -> pa.RecordBatch:
        runs = Runs(c)
        return _kinds_asked(c, runs, Kinds(c, runs, answers, buckets), buckets)

    def texts(c: pk.Chunk, answers: dict) -> pa.RecordBatch:
        runs = Runs(c)
        k = Kinds(c, runs, answers, buckets)
        o = Open(c, runs, k, answers, buckets)
        order, which, ends = o.dealt
        some = o.some[order]
        at = k.at[some]
        data, lens = runs.texts(c, at)
        cut = np.concatenate(([0], np.cumsum(lens)))
        place = (runs.anchor - runs.lo)[at]
        out: list[list] = [which.tolist(), [], [], [], [], []]
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            for column, v in zip(out[1:], (k.gram[some[i:j]], lens[i:j].astype(np.uint8), place[i:j].astype(np.uint8), k.ids[some[i:j]]), strict=False):
                column.append(v.tobytes())
            out[5].append(pk.squeezed(data[cut[i] : cut[j]]))
        order, which, ends = o.strings_dealt
        out[0] += (which + buckets).tolist()
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = order[i:j]
            whole, none = np.full(len(at), WINDOW, np.uint8), np.zeros(len(at), np.uint8)
            for column, v in zip(out[1:], (o.a[at], whole, none, o.ids[at]), strict=False):
                column.append(v.tobytes())
            out[5].append(pk.squeezed(o.strings[at].reshape(-1)))
        return pk.asked_blobs(c.number, out, ["gram", "lens", "place", "ids", "text"])

    def remove(c: pk.Chunk, answers: dict) -> pa.RecordBatch:
        runs = Runs(c)
        k = Kinds(c, runs, answers, buckets)
        gone = np.zeros(len(c.data) + 1, np.int32)
        if len(k.at):
            o = Open(c, runs, k, answers, buckets)
            whole = k.at[(k.ids > k.first_id[k.group]) | (o.earlier[k.group] > 0)]
            np.add.at(gone, runs.lo[whole], 1)
            np.subtract.at(gone, runs.hi[whole] + WINDOW, 1)
            bits = o.bits(answers, buckets)
            # Other runs of the first id share what its run found.
            bits_of = np.zeros(int(k.group[-1]) + 1, np.uint32)
            bits_of[k.group[o.all]] = bits
            mine = np.flatnonzero((k.ids == k.first_id[k.group]) & (bits_of[k.group] > 0))
            for n in range(WITHIN):
                lo = runs.lo[k.at[mine[(bits_of[k.group[mine]] >> np.uint32(n)) & np.uint32(1) > 0]]] + n
                np.add.at(gone, lo, 1)
                np.subtract.at(gone, lo + WINDOW, 1)
        keep = np.cumsum(gone[:-1]) == 0
        upto = np.concatenate(([0], np.cumsum(keep)))[c.offsets]
        edge = ~keep
        edge[1:] &= keep[:-1]
        starts = c.offsets[:-1][np.diff(c.offsets) > 0]
        edge[starts] = ~keep[starts]
        spans = np.diff(np.concatenate(([0], np.cumsum(edge)))[c.offsets])
        raw = c.data[keep].tobytes()
        parts = [raw[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]
        n = np.diff(c.offsets)
        columns = [pa.array(c.raw_ids, pa.int64()), pa.array(n), pa.array(n - np.diff(upto)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "kept_bytes"]
        return pa.RecordBatch.from_arrays(columns, names)

    shared = pk.meet(pk.ask(packed, None, anchors, "bucket int, chunk long, hash binary, flags binary"), 1, _shared)
    known = pk.meet(pk.ask(packed, shared, kinds, "bucket int, chunk long, a binary, b binary, ids binary, lens binary, offset binary, text binary"), 2, lambda rows: _earlier(rows) if rows[0]["bucket"] < buckets else grams_decided(rows))
    both = shared.unionByName(known)
    found = pk.meet(pk.ask(packed, both, texts, "bucket int, chunk long, gram binary, lens binary, place binary, ids binary, text binary"), 3, _open_decided)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    return pk.ask(packed, both.unionByName(found), remove, schema)
