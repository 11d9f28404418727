"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set holds its distinct shingles of five words (A to Z lower-cased; with fewer words the whole
sequence as one). The hash of a shingle picks a bin by its leading bits, the smallest hash of a bin is its value,
and an empty bin borrows the value of a bin drawn by a hash of its own number until that bin has one. Bands of
four of 128 bins make 32 bucket keys: a pair at the limit of 0.75 shares none with a chance of about 5e-6.

Documents with equal sets are one class and only its smallest id goes on. In each bucket the member that shares
most buckets with others is the hub and all others are compared with it, so a bucket of m costs m - 1 pairs, which
are confirmed on the full sets. Components come from alternating large and small stars. Then only buckets that hold
several components are open: those of at most ``SMALL`` members compare all pairs between components; in larger
ones another member of the largest component, drawn by a hash, is the hub for the members of all other components.
Turns follow until none confirms a link. The members of large buckets that are still open (texts that share a common
passage and little else) are then compared exactly, by a prefix filter that loses no link: with the shingles of each
set in one order, rare ones first, two linked sets share a shingle so early that enough of both is left after it. All
pairs between components that do are confirmed, in blocks where many share one shingle, so no bucket stays open.

Nulls: a null text has an empty set and no links; a null id takes no part (its component is null, and it is kept).
Rows that share an id are one document whose sets may each give links. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, hot_limit, scratch, spread_join, staged
from .textnum import U, column_bytes, mixed, rolled, row_of, slices, tokens, word_hashes

BINS, ROWS = 128, 4
#: In buckets of so many members all pairs between components are compared.
SMALL = 8
#: Counters of the sketch that orders shingles, rare ones first. Any order is exact; a good one gives few pairs.
COUNTERS = 1 << 18
#: Members of one shingle that meet another so many in one task.
BLOCK = 2048
#: Links whose components are found in one task; more take rounds of joins.
FEW_LINKS = 500_000
SHINGLE = 5


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its first row, its end, and row numbers and hashes, sorted and distinct."""
    data, offsets = column_bytes(column)
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = tokens(part, off)
        h = word_hashes(part, starts, ends, lower=True)
        row = row_of(first)
        counts = np.diff(first)
        runs = rolled(h, SHINGLE)
        whole = row[: len(runs)] == row[SHINGLE - 1 :] if len(runs) else np.zeros(0, bool)
        rows, hashes = row[: len(runs)][whole], runs[whole]
        for n in range(1, SHINGLE):  # the few rows shorter than a shingle
            short = first[:-1][counts == n]
            if len(short):
                acc = np.full(len(short), n, np.uint64)
                for d in range(n):
                    acc = mixed(acc * U(0x9E3779B97F4A7C15) + h[short + d])
                rows, hashes = np.concatenate((rows, row[short])), np.concatenate((hashes, acc))
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        if len(rows):
            new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])))
            rows, hashes = rows[new], hashes[new]
        yield i, j, rows, hashes


def signatures(n: int, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The densified bins of ``n`` rows; all zero for an empty set."""
    sig = np.zeros((n, BINS), np.uint64)
    full = np.zeros((n, BINS), bool)
    if len(rows):
        bins = (hashes >> U(57)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1]))))
        sig[rows[at], bins[at]] = hashes[at]
        full[rows[at], bins[at]] = True
    some = full.any(axis=1)
    r, c = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        draw = (mixed(np.arange(BINS, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(attempt)) % U(BINS)).astype(np.int64)
        hit = full[r, draw[c]]
        sig[r[hit], c[hit]] = sig[r[hit], draw[c[hit]]]
        r, c = r[~hit], c[~hit]
    return sig


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i, j, rows, hashes in shingle_sets(batch.column(1)):
            n = j - i
            sizes = np.bincount(rows, minlength=n)
            sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            for s, salt in zip(sums, (0x243F6A8885A308D3, 0x13198A2E03707344), strict=True):
                if len(rows):
                    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                    s[rows[at]] = np.add.reduceat(mixed(hashes ^ U(salt)), at)
            sig = signatures(n, rows, hashes)
            keys = np.zeros((n, BINS // ROWS), np.uint64)
            for d in range(ROWS):
                keys = mixed(keys * U(0x9E3779B97F4A7C15) + sig[:, d::ROWS])
            keys = mixed(keys + np.arange(BINS // ROWS, dtype=np.uint64) * U(0xA0761D6478BD642F))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (BINS // ROWS))
            bands = pa.ListArray.from_arrays(offsets, pa.array(_signed(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(sizes.astype(np.int64)), pa.array(_signed(sums[0])), pa.array(_signed(sums[1])), bands], ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, rows, hashes in shingle_sets(batch.column(1)):
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=j - i)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(hashes)))], ["id", "set"])


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For links (u, v) the nodes with the smallest node reachable, where that is another."""
    links = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack([c.to_numpy() for c in batch.columns]) for batch in batches)], axis=1)
    nodes, at = np.unique(links, return_inverse=True)
    u, v = at.reshape(links.shape)
    least, before = np.arange(len(nodes)), None
    while before is None or (least != before).any():
        before, a, b = least.copy(), least[u], least[v]
        np.minimum.at(least, a, b)
        np.minimum.at(least, b, a)
        while ((nearer := least[least]) != least).any():
            least = nearer
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["u", "v"])


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of (u, v) for links (a, b): node u and the smallest node reachable.

    Up to ``FEW_LINKS`` links go through one task; more take rounds of joins, which gather no node's links.
    ``rows``: so many links at most; up to ``FEW_LINKS`` that task reads ``links`` themselves, which should be a table.
    """
    with scratch(links.sparkSession) as keep:
        e, n = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), rows
        if n is None or n > FEW_LINKS:
            e = staged(e.distinct(), "cc", rows)
            n = e.count()
        if n <= FEW_LINKS:
            e = staged(e.coalesce(1).mapInArrow(_least_reachable, "u long, v long"), "cc")
            keep(e)
            return e
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc", n)
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = large.join(least, "u")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
            before, e, n_before = e, staged(small.distinct(), "cc", 2 * n), n
            n = e.count()
            if n == n_before and e.join(before, ["u", "v"], "left_anti").isEmpty():  # the same links as before
                keep(e)
                return e


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for distinct candidate pairs, on their full sets.

    A member of many pairs (a hub) has its set copied for each block of them, so its pairs spread over the tasks.
    """
    rows = pairs.count()
    limit = hot_limit(rows)
    if rows <= limit:  # no member is of so many
        for end in ("b", "a"):
            pairs = pairs.join(sets.toDF(end, f"s{end}"), end)
    else:
        degrees = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
        hubs = staged(degrees.where(F.col("count") > limit).select("id", F.ceil(F.col("count") / limit).alias("blocks")), "mh-hubs", 2 * rows // limit)
        blocks = F.coalesce("blocks", F.lit(1).cast("long"))
        copies = sets.join(F.broadcast(hubs), "id", "left").select("id", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "set")
        for end, other in (("a", "b"), ("b", "a")):
            dealt = F.pmod(F.xxhash64(other), blocks)
            pairs = pairs.join(F.broadcast(hubs.withColumnRenamed("id", end)), end, "left").withColumn(f"block_{end}", dealt).drop("blocks")
        for end in ("b", "a"):
            pairs = pairs.join(copies.toDF(end, f"block_{end}", f"s{end}"), [end, f"block_{end}"])
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.select("a", "b", (100 * both >= percent * (F.size("sa") + F.size("sb") - both)).alias("linked"))
    return staged(found.groupBy("a", "b").agg(F.max("linked").alias("linked")), "mh-checked", rows)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _central_stars(buckets: DataFrame, limit: int, rows: int) -> DataFrame:
    """Pairs of each bucket's members with the one that shares most buckets with others."""
    central = buckets.groupBy("rep").agg(F.sum("n").alias("shares"))
    hubs = buckets.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("shares", -F.col("rep"))).alias("hub"), F.first("n").alias("size"))
    return spread_join(buckets, staged(hubs, "mh-centres", rows // 2), "key", "size", limit).where("rep <> hub").select(*_ordered("hub", "rep")).distinct()


def _open_pairs(buckets: DataFrame, comps: DataFrame, turn: int, limit: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs between components of buckets, and the members of large buckets that hold several components."""
    labelled = buckets.join(comps.toDF("node", "component"), F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    labelled = staged(labelled, "mh-labelled", rows)
    drawn = F.xxhash64("rep", "key", F.lit(turn))
    by_comp = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("rep", drawn).alias("rep"))
    by_key = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.max_by(F.struct("rep", "comp"), F.struct("n", F.xxhash64("comp", "key", F.lit(turn)))).alias("hub"))
    open_ = staged(spread_join(labelled, staged(by_key.where("comps > 1"), "mh-open-keys", rows // 2), "key", "size", limit), "mh-open", rows)
    small, large = open_.where(F.col("size") <= SMALL), open_.where(F.col("size") > SMALL)
    other = small.select("key", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"))
    pairs = small.join(other, "key").where("rep < rep2 and comp <> comp2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    pairs = pairs.unionByName(large.where("comp <> hub.comp").select(*_ordered("hub.rep", "rep")))
    return pairs.distinct(), large.select("rep", "comp").distinct()


def _size_classes() -> np.ndarray:
    """The least size of each class of set sizes, which grow by a tenth."""
    least = [0, 1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, least[-1] * 11 // 10))
    return np.array(least, np.int64)


CLASSES = _size_classes()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists without nulls."""
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(COUNTERS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        counts += np.bincount(_counter(_lists(batch.column("set"))[1]), minlength=COUNTERS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["counter", "n"])


def _prefix_rows(counts: np.ndarray, percent: int, sizes: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """row, shingle, low, high, side and place of the shingles by which sets can meet linked sets of each size class.

    Two sets of n and m shingles are linked if they share percent * (n + m) / (100 + percent) or more. What they share
    lies at or after the first shared shingle in both, so in both that many are left there, itself included.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = counts[_counter(hashes)]
    order = np.lexsort((hashes, often, row))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(row)) - first[row]
    size = sizes[row]
    least = -(-percent * size // 100)  # of a linked set
    # A counter of one is a shingle of one set only.
    at = np.flatnonzero((often[order] > 1) & ((100 + percent) * (size - place) >= percent * (size + least)))
    row, place, size, least, shingle = row[at], place[at], size[at], least[at], hashes[order][at]
    mine = np.searchsorted(CLASSES, size, "right") - 1
    for sign in (1, -1):
        for d in range(0 if sign > 0 else 1, len(CLASSES)):
            other = np.clip(mine + sign * d, 0, len(CLASSES) - 2)
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            near = (other == mine + sign * d) & (100 * (CLASSES[low + 1] - 1) >= percent * CLASSES[high])
            if not near.any():
                break
            on = np.flatnonzero(near & ((100 + percent) * (size - place) >= percent * (size + np.maximum(least, CLASSES[other]))))
            yield row[on], shingle[on], low[on], high[on], np.full(len(on), sign * min(d, 1)), place[on]


def _exact_pairs(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs between components of the members (rep, comp) of large buckets: all that can be linked."""
    mine = staged(sets.join(large, F.col("id") == F.col("rep")).select("rep", "comp", "set"), "mh-open-sets")
    counts = np.zeros(COUNTERS, np.int64)  # the one thing that reaches the driver: a sketch of fixed size
    for r in mine.select("set").mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.counter] = r.n

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = _lists(batch.column("set"))
            for row, shingle, low, high, side, place in _prefix_rows(counts, percent, sizes, hashes):
                at = pa.array(row)
                columns = [batch.column("rep").take(at), batch.column("comp").take(at), pa.array(sizes[row]), pa.array(_signed(shingle)), pa.array(low), pa.array(high), pa.array(side), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "comp", "size", "shingle", "low", "high", "side", "place"])

    group = ["shingle", "low", "high"]
    rows = staged(mine.mapInArrow(prefixes, "rep long, comp long, size long, shingle long, low long, high long, side long, place long"), "mh-prefixes")
    n = rows.count()
    blocks = rows.groupBy(*group).agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select(*group, "n", "blocks")
    rows = spread_join(rows, staged(blocks, "mh-blocks", n // 2), group, "n", hot_limit(n))
    rows = staged(rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))), "mh-grouped", n)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = rows.where("side >= 0").select(*group, F.col("block").alias("i"), every.alias("j"), *[F.col(c).alias(f"{c}_a") for c in ("rep", "comp", "size", "place")])
    b = rows.where("side <= 0").select(*group, every.alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("rep", "comp", "size", "place")])
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    can = (F.col("comp_a") != F.col("comp_b")) & ((F.col("low") < F.col("high")) | (F.col("rep_a") < F.col("rep_b"))) & ((100 + percent) * left >= percent * (F.col("size_a") + F.col("size_b")))
    return a.join(b, [*group, "i", "j"]).where(can).select(*_ordered("rep_a", "rep_b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        return _near_duplicates(docs, percent, id_col, text_col, keep)


def _near_duplicates(docs: DataFrame, percent: int, id_col: str, text_col: str, keep: Callable[..., None]) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = staged(texts.mapInArrow(_sign, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "mh-signatures")
    key = ["n_shingles", "k1", "k2"]
    sets_of = sig.where("n_shingles > 0 and doc_id is not null").groupBy(*key)
    classes = staged(sets_of.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "mh-classes", sig.count(), FILE_ROWS * ROWS // BINS)
    members = classes.select("rep", F.explode("bands").alias("key"))
    rows = classes.count() * (BINS // ROWS)
    limit = hot_limit(rows)
    shared = staged(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "mh-shared", rows // 2)
    rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = staged(spread_join(members, shared, "key", "n", limit).select("key", "rep", "n"), "mh-buckets", rows)  # of two and more
    nodes = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = staged(texts.join(nodes, "doc_id", "left_semi").mapInArrow(_set_rows, "id long, set array<long>"), "mh-sets")

    checked = _confirmed(staged(_central_stars(buckets, limit, rows), "mh-pairs", rows), sets, percent)
    n_checked = checked.count()
    comps, turn, more = components(checked.where("linked").select("a", "b"), n_checked), 0, True
    while more:
        turn += 1
        pairs, large = _open_pairs(buckets, comps, turn, limit, rows)
        pairs = staged(pairs.join(checked, ["a", "b"], "left_anti"), "mh-pairs", SMALL // 2 * rows)  # fewer for a member
        found = _confirmed(pairs, sets, percent)
        more = not found.where("linked").isEmpty()
        if not more and not large.isEmpty():
            pairs = staged(_exact_pairs(large, sets, percent).join(checked, ["a", "b"], "left_anti"), "mh-pairs")
            found = found.unionByName(_confirmed(pairs, sets, percent))
        n_checked += found.count()
        checked = checked.unionByName(found)
        if more or not large.isEmpty():
            comps = components(checked.where("linked").select("a", "b"), n_checked)
    keep(sig, classes, comps)
    comps = classes.select(*key, "rep").join(comps.toDF("node", "component"), F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", *key).join(comps, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
