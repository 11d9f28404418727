"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Test items and documents are compared as words, lower-cased. A document leaks an item if 13 consecutive
words of it, laid along 13 consecutive words of the item, agree in 11 places or more. The seed's mask keeps the first
of every three of ten places and ignores the others. At three consecutive shifts it keeps three disjoint sets of
words of such a run, and two substitutions spoil two of them at most: so joining the hashes of the kept words of all
places of documents and items finds every leak. Each hit is verified word by word over the runs around it. In ``leaks``
items of 10 to 12 words must appear whole and unchanged. All items under 13 words are reported by ``short_leaks``, with a
tolerance in proportion: one substitution from 7 words on, none in shorter ones. ``all_leaks`` has both.

The items' hashes are broadcast while they number at most ``broadcast_rows`` (of some 200 bytes each); beyond that both
sides are shuffled by hash, and only documents with a hit bring their words.

Nulls: null texts have no words. A leak in a document without an id is reported under null, an item without an id
has a null ``item_id``. Repeated items are one: ``item_id`` is their smallest id, ``n_items`` their number, and
``item_classes`` tells the ``item_id`` of each. Rows that share a document id are reported under it together. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words

SPAN, AGREE, SHORTEST = 13, 11, 10
MASK = (0, 3, 6, 9)
#: Runs of 13 words that hold a seed begin at its place or up to three words before.
BEFORE = SPAN - 10
BROADCAST_ROWS = 200_000


def _hashed(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _seed(h: Column, p: Column) -> Column:
    return F.xxhash64(*[F.get(h, p + i) for i in MASK])


def _around(h: Column, p: Column) -> Column:
    """The words of all runs that hold the seed at ``p``; null beyond the ends."""
    return F.transform(F.sequence(F.lit(-BEFORE), F.lit(SPAN - 1)), lambda i: F.get(h, (p + i).cast("int")))


def _agreement(a: Column, b: Column) -> Column:
    """The most words in which a run of 13 agrees."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    sums = F.transform(F.sequence(F.lit(1), F.lit(BEFORE + 1)), lambda s: F.aggregate(F.slice(same, s, F.lit(SPAN)), F.lit(0), lambda t, v: t + v))
    return F.array_max(sums)


def _row(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart where ids may be null or repeated: 128 bits of hashes, the same at every evaluation."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(text, doc_id, F.lit(1)).alias("r2")]


def item_classes(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item and the item_id under which ``leaks`` report it, of every item with words."""
    tests = items.select(F.col(item_col).cast("long").alias("item"), _hashed(F.col(item_text_col)).alias("g")).where(F.size("g") > 0)
    return tests.join(tests.groupBy("g").agg(F.min("item").alias("item_id")), "g").select("item", "item_id")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_items, n_hits (verified places) and best (most words that agree in a run), for each leak."""
    tests = items.select(F.col(item_col).cast("long").alias("item"), _hashed(F.col(item_text_col)).alias("g")).where(F.size("g") >= SHORTEST)
    tests = tests.groupBy("g").agg(F.min("item").alias("item_id"), F.count("*").alias("n_items"))
    tests = staged(tests.withColumn("item_row", F.monotonically_increasing_id()), "decon-items")  # ids may be null
    places = F.explode(F.sequence(F.lit(0), F.size("g") - SHORTEST))
    seeds = tests.select("item_row", "g", places.alias("q")).where((F.size("g") >= SPAN) | (F.col("q") == 0))
    # Of items under 13 words, the whole is what must agree.
    need = F.when(F.size("g") >= SPAN, F.lit(AGREE)).otherwise(F.size("g"))
    seeds = staged(seeds.select(_seed(F.col("g"), F.col("q")).alias("seed"), "item_row", "q", need.alias("need"), _around(F.col("g"), F.col("q")).alias("run")), "decon-seeds")

    h = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hashed(F.col(text_col)).alias("h"), *_row(F.col(id_col), F.col(text_col)))
    # No filter on the length, which would hash all words once more to push itself down.
    places = F.when(F.size("h") >= SHORTEST, F.sequence(F.lit(0), F.size("h") - SHORTEST)).otherwise(F.array().cast("array<int>"))
    hits = h.select("doc_id", "h", "r1", "r2", F.explode(places).alias("p")).withColumn("seed", _seed(F.col("h"), F.col("p")))
    if seeds.count() <= broadcast_rows:
        found = hits.join(F.broadcast(seeds), "seed")
    else:
        narrow = hits.select("r1", "r2", "p", "seed").join(seeds.select("seed", "item_row", "q"), "seed").distinct()
        found = narrow.join(h, ["r1", "r2"]).join(seeds, ["seed", "item_row", "q"])
    # As a generator: a filter would move into the join's condition and take the join out of generated code.
    same = _agreement(_around(F.col("h"), F.col("p")), F.col("run"))
    found = found.select("doc_id", "item_row", "p", "need", F.explode(F.array(same)).alias("same")).where("same >= need")
    found = found.groupBy("doc_id", "item_row").agg(F.countDistinct("p").alias("n_hits"), F.max("same").cast("long").alias("best"))
    return found.join(tests.select("item_row", "item_id", "n_items"), "item_row").select("doc_id", "item_id", "n_items", "n_hits", "best")


def short_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As ``leaks``, for items of 1 to 12 words: they lie along a document's words, with 2 in 13 substituted, rounded down.

    So at most one word differs, and one half of an item of 7 words or more is unchanged: runs of the halves' lengths
    (of whole items under 7 words) are joined by hash and the rest is verified.
    """
    tests = items.select(F.col(item_col).cast("long").alias("item"), _hashed(F.col(item_text_col)).alias("g")).where(F.size("g").between(1, SPAN - 1))
    tests = tests.groupBy("g").agg(F.min("item").alias("item_id"), F.count("*").alias("n_items"))
    tests = staged(tests.withColumn("item_row", F.monotonically_increasing_id()), "decon-short-items")
    n, spare = F.size("g"), F.floor(F.size("g") * (SPAN - AGREE) / SPAN)
    half = F.floor(n / 2).cast("int")
    part = lambda a, b: F.struct(a.alias("q"), b.alias("width"))
    parts = F.when(spare == 0, F.array(part(F.lit(0), n))).otherwise(F.array(part(F.lit(0), half), part(half, n - half)))
    seeds = tests.select("item_row", "g", (n - spare).alias("need"), F.explode(parts).alias("part")).select("item_row", "g", "need", "part.*")
    seeds = staged(seeds.withColumn("seed", F.xxhash64("width", F.slice("g", F.col("q") + 1, F.col("width")))), "decon-short-seeds")
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())  # six at most

    h = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hashed(F.col(text_col)).alias("h"), *_row(F.col(id_col), F.col(text_col)))

    def run(w: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda p: F.struct(p.alias("at"), F.xxhash64(F.lit(w), F.slice("h", p + 1, F.lit(w))).alias("seed")))

    runs = F.flatten(F.array(*[run(w) for w in widths]))
    runs = F.when(F.size("h") > 0, runs) if widths else F.lit(None).cast("array<struct<at:int,seed:bigint>>")
    hits = h.select("doc_id", "h", "r1", "r2", F.explode(runs).alias("run")).select("doc_id", "h", "r1", "r2", "run.*")
    if seeds.count() <= broadcast_rows:
        found = hits.join(F.broadcast(seeds), "seed")
    else:
        narrow = hits.select("r1", "r2", "at", "seed").join(seeds.select("seed", "item_row", "q"), "seed").distinct()
        found = narrow.join(h, ["r1", "r2"]).join(seeds, ["seed", "item_row", "q"])
    found = found.withColumn("p", F.col("at") - F.col("q"))
    agree = F.transform("g", lambda x, i: F.coalesce((F.get("h", F.col("p") + i) == x).cast("int"), F.lit(0)))
    same = F.aggregate(agree, F.lit(0), lambda t, v: t + v)
    found = found.select("doc_id", "item_row", "p", "need", F.explode(F.array(same)).alias("same")).where("same >= need")
    found = found.groupBy("doc_id", "item_row").agg(F.countDistinct("p").alias("n_hits"), F.max("same").cast("long").alias("best"))
    return found.join(tests.select("item_row", "item_id", "n_items"), "item_row").select("doc_id", "item_id", "n_items", "n_hits", "best")


def all_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``leaks`` of items of 13 words and more, and ``short_leaks``."""
    n = F.size(words(F.col("text")))
    long, short = items.where(n >= SPAN), items.where(n.between(1, SPAN - 1))
    found = leaks(docs, long)
    return found if short.isEmpty() else found.unionByName(short_leaks(docs, short))
