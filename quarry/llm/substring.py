"""Substring deduplication over words by fixed-block anchors.

A window of 20 words is removed if its sequence also starts earlier: in a document of a smaller id, or of the same id at
an earlier place. Every text is cut into non-overlapping reference blocks of 10 words, which are indexed; every rolling
window of 10 words of every text probes the index. Any window of 20 words holds a whole block of its own text, and any
equal window holds the same words as a rolling window, so both see a hit, and only windows over hits can repeat.

1. Blocks and probes travel as 32-bit fingerprints in buckets, once for each chunk of texts. What is equal there by
   chance alone is hit for nothing, which costs time and no more.
2. The anchor of a window is its hit of smallest hash (the leftmost of equals), so equal windows have equal anchors at
   equal places. Neighbouring windows with the same anchor make a run: the hit with up to 10 words on either side. Of
   runs of the same words (by 96 bits of hashes besides the bucket) all but the earliest are covered whole.
3. The earliest run of its words is open if its anchor has runs of other words (told by 64 bits of a hash). Open runs meet by anchor, with their
   words, and are extended from the hit word by word, to the left and to the right: runs stay together as long as their
   next words are equal, letter by letter. Windows whose extensions to both sides agree are equal, and each learns
   if it starts earlier elsewhere. Of an anchor with a crowd of runs the single windows meet by their words alone.

Overlapping windows that start earlier elsewhere make the maximal repeats, which are removed.

Rows that share an id are one document: equal starts are no earlier. A null id comes before all others. Null texts have
no words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as pk
from .suffixes import CROWD, SEVERAL, grams_decided, run_hashes
from .textnum import WORDS, U, mixed, rolled, row_of, tokens, word_hashes

WINDOW = 20
BLOCK = 10  # a window of 2 * BLOCK - 1 words and more holds a whole block
WITHIN = WINDOW - BLOCK + 1  # blocks in a window
NEVER = U((1 << 64) - 1)


class Words:
    """The words of a chunk and their rolling hashes."""

    def __init__(self, c: pk.Chunk):
        self.starts, self.ends, self.first = tokens(c.data, c.offsets)
        self.row = row_of(self.first)
        self.h = word_hashes(c.data, self.starts, self.ends)
        self.joined(c.data)
        self.place = np.arange(len(self.row)) - self.first[self.row] if len(self.row) else np.zeros(0, np.int64)

    def joined(self, data: np.ndarray) -> None:
        """Make ``text`` the chunk's words with a space after each, and ``begin`` the place of each word in it and its end."""
        lens = self.ends - self.starts + 1
        self.begin = np.concatenate(([0], np.cumsum(lens)))
        self.text = np.full(int(self.begin[-1]), 32, np.uint8)
        for i in range(0, len(lens), WORDS):
            some = slice(i, i + WORDS)
            self.text[pk.places(self.begin[:-1][some], lens[some] - 1)] = data[pk.places(self.starts[some], lens[some] - 1)]

    def bytes_of(self, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the text of ``n`` words from each place begins, and how many bytes it has with the space at its end."""
        return self.begin[lo], self.begin[lo + n] - self.begin[lo]

    def whole(self, n: int) -> np.ndarray:
        """Places where ``n`` words of one row begin."""
        if len(self.row) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])


def _probes(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of rolling windows; their distinct hashes; which of these each has; flags 1: is a block, 2: is there twice."""
    at = w.whole(BLOCK)
    h, which, count = np.unique(rolled(w.h, BLOCK)[at] if len(at) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    flags = np.where(count > 1, 2, 0).astype(np.uint8)
    flags[which[w.place[at] % BLOCK == 0]] |= 1
    return at, h, which, flags


class Runs:
    """The runs of a chunk: first and last window, place and hash of the anchor, id and place of the first window."""

    def __init__(self, c: pk.Chunk, w: Words, answers: dict, buckets: int):
        at, h, which, _ = _probes(w)
        n = len(w.row)
        key = np.full(n, NEVER)
        hot = pk.answered(c.number, h, answers, 1, buckets)[which] if len(h) else np.zeros(0, bool)
        key[at[hot]] = (h[which[hot]] >> U(32) << U(32)) | at[hot].astype(np.uint64)
        windows = w.whole(WINDOW)
        low, width = key, 1
        while width * 2 <= WITHIN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[windows], low[windows + WITHIN - width]) if len(windows) else np.zeros(0, np.uint64)
        windows, low = windows[low != NEVER], low[low != NEVER]
        anchor = (low & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1) | (w.row[windows[1:]] != w.row[windows[:-1]])
        first = np.flatnonzero(new)
        self.lo, self.anchor = windows[first], anchor[first]
        self.hi = windows[np.append(first[1:], len(windows)) - 1] if len(first) else self.lo
        hash_at = np.zeros(n, np.uint64)
        hash_at[at] = h[which] if len(h) else 0
        self.gram, self.ids, self.place = hash_at[self.anchor], c.ids[w.row[self.lo]], w.place[self.lo]


class Kinds:
    """The runs in the order of (anchor, hashes of their words, id, place)."""

    def __init__(self, w: Words, r: Runs):
        lens = r.hi - r.lo + WINDOW
        words = w.h[pk.places(r.lo, lens)]
        a = mixed(run_hashes(words, lens, 0) + (r.anchor - r.lo).astype(np.uint64) * U(0x9E3779B97F4A7C15)) if len(lens) else np.zeros(0, np.uint64)
        b = run_hashes(mixed(words ^ U(0x94D049BB133111EB)), lens, 1)
        self.at = np.lexsort((r.place, r.ids, b, a, r.gram))
        self.a, self.b, self.gram, self.ids, self.place = a[self.at], b[self.at], r.gram[self.at], r.ids[self.at], r.place[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = self.gram[1:] != self.gram[:-1]
        self.opens = new.copy()
        self.opens[1:] |= (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
        # Letters have the last word. Runs that they part are compared again where their kinds meet.
        self.begin, self.size = (x[self.at] for x in w.bytes_of(r.lo, lens))
        self.offset, near = (r.anchor - r.lo)[self.at], np.flatnonzero(~self.opens)
        self.opens[near] = (self.size[near] != self.size[near - 1]) | (self.offset[near] != self.offset[near - 1])
        near = near[~self.opens[near]]
        self.opens[near] = ~pk.same_bytes(w.text, self.begin[near - 1], self.begin[near], self.size[near])
        self.group, self.first = np.cumsum(self.opens) - 1, np.flatnonzero(self.opens)
        self.gram_first, self.gram_group = np.flatnonzero(new), np.cumsum(new) - 1
        self.kinds_here = np.add.reduceat(self.opens.astype(np.int64), self.gram_first) if len(new) else np.zeros(0, np.int64)
        #: Runs that stand no later than the first of their kind here.
        of_first = self.first[self.group]
        self.as_first = (self.ids == self.ids[of_first]) & (self.place == self.place[of_first]) if len(new) else new

    def by_kind(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pk.dealt_to((self.a[self.first] % U(buckets)).astype(np.int64))

    def by_gram(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pk.dealt_to((self.gram[self.gram_first] % U(buckets)).astype(np.int64))

    def asked(self, c: pk.Chunk, w: Words, buckets: int) -> pa.RecordBatch:
        """Two questions: kinds with their words, dealt by a hash of these, with the first here; and anchors, with one of
        their kinds and how many this chunk has. So an anchor that is everywhere costs a few bytes a chunk."""
        arrays: list[list] = [[] for _ in range(8)]
        f, g = self.first, self.gram_first
        order, which, ends = self.by_kind(buckets)
        columns = (self.a[f], self.ids[f], self.place[f].astype(np.int32), self.size[f].astype(np.uint32), self.offset[f].astype(np.uint8))
        arrays[0] += which.tolist()
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            some = order[i:j]
            for out, v in zip((arrays[1], *arrays[3:7]), columns, strict=True):
                out.append(v[some].tobytes())
            arrays[2].append(None)
            arrays[7].append(pk.squeezed(w.text[pk.places(self.begin[f[some]], self.size[f[some]])]))
        order, which, ends = self.by_gram(buckets)
        columns = (pk.fingerprint(self.gram[g], buckets), self.a[g] ^ self.b[g], np.minimum(self.kinds_here, 65535).astype(np.uint16))
        arrays[0] += (which + buckets).tolist()
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            for out, v in zip(arrays[1:4], columns, strict=True):
                out.append(v[order[i:j]].tobytes())
            for out in arrays[4:]:
                out.append(None)
        return pk.asked_blobs(c.number, arrays, ["a", "b", "ids", "places", "sizes", "offset", "words"])


class Open:
    """The earliest runs of their words whose anchor has others: those that are extended, and single windows of crowds."""

    def __init__(self, w: Words, r: Runs, k: Kinds, answers: dict, buckets: int):
        self.earlier = pk.read_answers(k.by_kind(buckets), answers, 2, np.uint8)
        gram = pk.read_answers(k.by_gram(buckets), answers, 2, np.uint8, buckets)
        open_ = k.opens & (self.earlier[k.group] == 0) if len(k.at) else np.zeros(0, bool)
        of_gram = gram[k.gram_group] if len(k.at) else np.zeros(0, np.uint8)
        self.some, crowd = np.flatnonzero(open_ & (of_gram == SEVERAL)), np.flatnonzero(open_ & (of_gram == CROWD))
        self.all = np.concatenate((self.some, crowd))
        self.dealt = pk.dealt_to((k.gram[self.some] % U(buckets)).astype(np.int64))
        lo, n = r.lo[k.at[crowd]], r.hi[k.at[crowd]] - r.lo[k.at[crowd]] + 1
        self.run = np.repeat(np.arange(len(crowd)), n)
        self.start = pk.places(lo, n)
        self.shift = self.start - lo[self.run] if len(crowd) else self.start
        self.key = run_hashes(w.h[pk.places(self.start, np.full(len(self.start), WINDOW))], np.full(len(self.start), WINDOW), 0)
        self.single_dealt = pk.dealt_to((self.key % U(buckets)).astype(np.int64))
        self.ids, self.place = (k.ids[crowd][self.run], k.place[crowd][self.run] + self.shift) if len(crowd) else (self.start, self.start)

    def asked(self, c: pk.Chunk, w: Words, r: Runs, k: Kinds, buckets: int) -> pa.RecordBatch:
        at = k.at[self.some]
        out: list[list] = [[], [], [], [], [], [], []]
        groups = (
            (self.dealt, 0, k.gram[self.some], r.lo[at], r.hi[at] - r.lo[at] + WINDOW, r.anchor[at] - r.lo[at], k.ids[self.some], k.place[self.some]),
            (self.single_dealt, buckets, self.key, self.start, np.full(len(self.start), WINDOW), np.zeros(len(self.start), np.int64), self.ids, self.place),
        )
        for (order, which, ends), base, gram, lo, lens, offset, ids, place in groups:
            out[0] += (which + base).tolist()
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                some = order[i:j]
                columns = (gram[some], lens[some].astype(np.uint8), offset[some].astype(np.uint8), ids[some], place[some].astype(np.int32))
                for column, v in zip(out[1:], columns, strict=False):
                    column.append(v.tobytes())
                out[6].append(pk.squeezed(w.text[pk.places(*w.bytes_of(lo[some], lens[some]))]))
        return pk.asked_blobs(c.number, out, ["gram", "lens", "offset", "ids", "places", "words"])

    def bits(self, answers: dict, buckets: int) -> np.ndarray:
        """A bit for each window of the open runs, in the order of ``all``."""
        crowd = np.zeros(len(self.all) - len(self.some), np.uint32)
        later = pk.read_answers(self.single_dealt, answers, 3, np.uint32, buckets)
        np.bitwise_or.at(crowd, self.run, later << self.shift.astype(np.uint32))
        return np.concatenate((pk.read_answers(self.dealt, answers, 3, np.uint32), crowd))


def _hot(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    """A fingerprint is hot if it is a block somewhere and occurs twice."""
    marks = [np.frombuffer(r["hash"], np.uint32) for r in rows]
    lengths = [len(x) for x in marks]
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
    _, which, count = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    block = np.bincount(which, flags & 1, len(count)) > 0
    twice = (count > 1) | (np.bincount(which, flags & 2, len(count)) > 0)
    return lengths, (block & twice)[which]


def _read(rows: list[dict], **types: type) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[name], kind) for r in rows]) for name, kind in types.items()]


def _later(kind: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of several things of a kind stand after the first of it, by id and place."""
    order = np.lexsort((place, ids, kind))
    opens = np.ones(len(order), bool)
    opens[1:] = kind[order][1:] != kind[order][:-1]
    first = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    out = np.zeros(len(order), bool)
    out[order] = (ids[order] != ids[first]) | (place[order] != place[first])
    return out


def _kinds_decided(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    """For kinds with the first of a chunk: whether another chunk has an earlier one."""
    a, ids, place, sizes, offset = _read(rows, a=np.uint64, ids=np.int64, places=np.int32, sizes=np.uint32, offset=np.uint8)
    words = np.concatenate([np.frombuffer(pk.loose(r["words"]), np.uint8) for r in rows])
    kind = pk.classes([a, offset], words, sizes.astype(np.int64))
    return [len(r["offset"]) for r in rows], _later(kind, ids, place).astype(np.uint8)


def _refined(kind: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of equal class and equal next word; words below zero are none, and make a class for each."""
    n = len(word)
    word = np.where(word < 0, np.arange(n), n + word)
    return np.unique(kind * (int(word.max(initial=0)) + 1) + word, return_inverse=True)[1]


def _extended(rows: list[dict]) -> tuple[list[int], np.ndarray]:
    """For each open run a bit a window: whether it also starts earlier. Hits are extended word by word to both sides."""
    gram, lens, offset, ids, place = _read(rows, gram=np.uint64, lens=np.uint8, offset=np.uint8, ids=np.int64, places=np.int32)
    lens, offset = lens.astype(np.int64), offset.astype(np.int64)
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(x, len(numbers)) for r in rows for x in pk.loose(r["words"]).split(b" ")[:-1]], np.int64)
    begin = np.cumsum(lens) - lens

    def word(at: np.ndarray) -> np.ndarray:
        """The word of each run at a place in it, -1 beyond its ends."""
        there = (at >= 0) & (at < lens)
        return np.where(there, words[np.where(there, begin + at, 0)], -1)

    hit = np.unique(gram, return_inverse=True)[1].reshape(-1)
    for i in range(BLOCK):  # a hash may deceive
        hit = _refined(hit, word(offset + i))
    left, right = [hit], [hit]
    for i in range(WITHIN - 1):
        left.append(_refined(left[-1], word(offset - 1 - i)))
        right.append(_refined(right[-1], word(offset + BLOCK + i)))
    bits = np.zeros(len(gram), np.uint32)
    for i in range(WITHIN):  # windows that begin i words before the hit
        some = np.flatnonzero((offset >= i) & (offset - i + WINDOW <= lens))
        both = left[i][some] * np.int64(len(gram)) + right[WITHIN - 1 - i][some]
        later = _later(both, ids[some], place[some] + offset[some] - i)
        bits[some] |= later.astype(np.uint32) << (offset[some] - i).astype(np.uint32)
    return [len(r["lens"]) for r in rows], bits


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, with the words kept as ``kept_text`` left to ``kept``."""
    return _run(docs, id_col, text_col, False)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row."""
    return _run(docs, id_col, text_col, True)


def _run(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    packed = pk.pack(docs, id_col, text_col)
    size = packed.agg(F.sum("size")).first()[0] or 0
    buckets = pk.bucket_count(spark, size // 6)

    def probe(c: pk.Chunk, _: dict) -> pa.RecordBatch:
        _, h, _, flags = _probes(Words(c))
        return pk.asked(c.number, h, {"hash": pk.fingerprint(h, buckets), "flags": flags}, buckets)

    def kinds(c: pk.Chunk, answers: dict) -> pa.RecordBatch:
        w = Words(c)
        return Kinds(w, Runs(c, w, answers, buckets)).asked(c, w, buckets)

    def extend(c: pk.Chunk, answers: dict) -> pa.RecordBatch:
        w = Words(c)
        r = Runs(c, w, answers, buckets)
        k = Kinds(w, r)
        return Open(w, r, k, answers, buckets).asked(c, w, r, k, buckets)

    def remove(c: pk.Chunk, answers: dict) -> pa.RecordBatch:
        w = Words(c)
        r = Runs(c, w, answers, buckets)
        k = Kinds(w, r)
        o = Open(w, r, k, answers, buckets)
        gone = np.zeros(len(w.row) + 1, np.int64)
        if len(k.at):
            whole = k.at[~k.as_first | (o.earlier[k.group] > 0)]
            np.add.at(gone, r.lo[whole], 1)
            np.subtract.at(gone, r.hi[whole] + WINDOW, 1)
            # Runs that stand where the first of their words does share what it found.
            found = np.zeros(len(k.first), np.uint32)
            found[k.group[o.all]] = o.bits(answers, buckets)
            mine = np.flatnonzero(k.as_first & (found[k.group] > 0))
            for i in range(WITHIN):
                lo = r.lo[k.at[mine[(found[k.group[mine]] >> np.uint32(i)) & np.uint32(1) > 0]]] + i
                np.add.at(gone, lo, 1)
                np.subtract.at(gone, lo + WINDOW, 1)
        keep = np.cumsum(gone[:-1]) == 0
        # The kept words of the chunk, each with a space after it; rows are cut out of these.
        w.starts, w.ends = w.starts[keep], w.ends[keep]
        w.joined(c.data)
        ends, raw = w.begin, w.text.tobytes()
        upto = np.concatenate(([0], np.cumsum(keep)))[w.first]
        texts = [raw[ends[i] : max(ends[i], ends[j] - 1)] for i, j in zip(upto[:-1], upto[1:], strict=True)]
        n_words = np.diff(w.first)
        columns = [pa.array(c.raw_ids, pa.int64()), pa.array(n_words), pa.array(n_words - np.diff(upto)), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
        return pa.RecordBatch.from_arrays(columns, names)

    hot = pk.meet(pk.ask(packed, None, probe, "bucket int, chunk long, hash binary, flags binary"), 1, _hot)
    known = pk.meet(pk.ask(packed, hot, kinds, "bucket int, chunk long, a binary, b binary, ids binary, places binary, sizes binary, offset binary, words binary"), 2, lambda rows: _kinds_decided(rows) if rows[0]["bucket"] < buckets else grams_decided(rows))
    both = hot.unionByName(known)
    found = pk.meet(pk.ask(packed, both, extend, "bucket int, chunk long, gram binary, lens binary, offset binary, ids binary, places binary, words binary"), 3, _extended)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return pk.ask(packed, both.unionByName(found), remove, schema)
