"""Language identification by Bayesian evidence fusion.

The text gives a log-likelihood for each language: byte trigrams, hashed, under multinomial models that are
trained on a bounded sample of labelled texts (``SAMPLE`` rows). Three more pieces of evidence are added in log
space: the language that the markup declares, the language that the address suggests (a path part, a leading
label or the country suffix), each through a confusion rate, and a prior for the host. Host priors are counts of
what the text alone says, by grouped aggregation, smoothed towards their domain, and domains towards all rows.

Nulls: a null text has no trigrams, so its other evidence decides; a null address has no host of its own and no
suggestion. A document without letters, known declaration and suggestion has no language, and its confidence is null.
Rows are judged one by one; repeated rows get equal results. With no training rows all languages are null. Markup is
read in one pass, whatever it leaves unclosed; long texts are scored in blocks of ``BLOCK`` bytes.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, staged
from .textnum import column_bytes

#: Most labelled rows that models are trained on. Every language among them has a model of 128 KB.
SAMPLE = 4000
BUCKETS = 1 << 15
#: Bytes of text that are scored at a time.
BLOCK = 1 << 18
#: Hosts of more rows have their priors broadcast: at most one host for each so many rows. Others are joined by a shuffle.
HOT = 100_000
#: Trigrams overlap, so each counts for a third; a text's evidence is that of this many trigrams at most.
WEIGHT, LONGEST = 1 / 3, 600
#: How often the markup and the address name the right language; the rest is shared by the others.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
DOMAIN_STRENGTH, HOST_STRENGTH = 20.0, 10.0
#: Country suffixes of addresses, each with the language that most of the country writes.
SUFFIXES = {
    "ar": "es", "at": "de", "au": "en", "bg": "bg", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de", "dk": "da", "ee": "et", "es": "es", "fi": "fi",
    "fr": "fr", "gr": "el", "hr": "hr", "hu": "hu", "ie": "en", "il": "he", "ir": "fa", "is": "is", "it": "it", "jp": "ja", "kr": "ko", "lt": "lt", "lv": "lv", "mx": "es",
    "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "rs": "sr", "ru": "ru", "se": "sv", "si": "sl", "sk": "sk", "th": "th", "tr": "tr",
    "tw": "zh", "ua": "uk", "uk": "en", "us": "en", "uy": "es", "ve": "es", "vn": "vi",
}


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hashes of all byte trigrams, with digits and ASCII signs as spaces and ASCII letters in lower case."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    d = fold[data].astype(np.uint32)
    x = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    plain = (x & 0xFFFF) == 0x2020  # runs of blanks say nothing
    h = ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    h[plain] = -1
    return h


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        data, off = column_bytes(batch.column(0))
        for i, lang in enumerate(batch.column(1).to_pylist()):
            part = data[off[i] : off[i + 1]]
            if len(part) > 2:
                h = _trigrams(part)
                total[lang] = total.get(lang, 0) + np.bincount(h[h >= 0], minlength=BUCKETS)
                rows[lang] = rows.get(lang, 0) + 1
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([rows[x] for x in total]), pa.array([total[x].astype(np.float32).tobytes() for x in total])], ["lang", "rows", "counts"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Languages and their log-probabilities over trigram buckets, from ``sample`` rows picked by a hash."""
    rows = labelled.select(F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang"), F.col(id_col).alias("id")).where("text is not null and lang is not null")
    picked = sampled(rows, sample, "id", "lang")
    found = picked.mapInArrow(_counts, "lang string, rows long, counts binary").collect()  # of a bounded sample
    by: dict[str, tuple[int, np.ndarray]] = {}
    for r in found:
        n, c = by.get(r.lang, (0, 0))
        by[r.lang] = n + r.rows, c + np.frombuffer(r.counts, np.float32).astype(np.float64)
    langs = sorted(by)
    logs = np.array([np.log((by[x][1] + 0.5) / (by[x][1].sum() + 0.5 * BUCKETS)) for x in langs]).reshape(len(langs), BUCKETS)
    return {"langs": langs, "logs": (logs - logs.max(axis=0, keepdims=True) if len(langs) else logs).astype(np.float32)}


_OPENS = re.compile(r"<(?:(script|style)\b|(!--))?", re.IGNORECASE)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_COMMENT_ENDS = re.compile("-->")
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})", re.IGNORECASE)


def visible(markup: str) -> tuple[str, str | None]:
    """The text of a page and the language that its first ``html`` tag declares.

    Scripts, styles, comments and tags become blanks. What has once been found to close nowhere isn't looked for again,
    so a page is read once.
    """
    parts, at, open_ = [], 0, {"script", "style", "--", ">"}
    while m := _OPENS.search(markup, at):
        end = -1
        kind = m[1].lower() if m[1] else "--" if m[2] else ">"
        if kind in open_ and kind != ">":
            close = _CLOSES[kind].search(markup, m.end()) if m[1] else _COMMENT_ENDS.search(markup, m.end())
            end = close.end() if close else -1
            if end < 0:
                open_.discard(kind)
        if end < 0 and ">" in open_:
            end = markup.find(">", m.start() + 1) + 1 or -1
            if end < 0:
                open_.discard(">")
        if end < 0:  # nothing closes it: a sign of the text
            parts.append(markup[at : m.start() + 1])
            at = m.start() + 1
        else:
            parts += [markup[at : m.start()], " "]
            at = end
    html = _HTML.search(markup)
    said = _LANG.search(markup[html.end() :].partition(">")[0]) if html else None
    return html_lib.unescape("".join([*parts, markup[at:]])), said[1].lower() if said else None


def _likelihoods(model: dict, markup: bool):
    logs, k = model["logs"], len(model["langs"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, len(batch), 256):
                b = batch.slice(n, 256)
                texts, declared = b.column(1), b.column(2)
                if markup:
                    pairs = [visible(x or "") for x in texts.to_pylist()]
                    texts, declared = pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())
                data, off = column_bytes(texts)
                out, seen = np.zeros((len(b), k)), np.zeros(len(b))
                for i in range(0, max(0, len(data) - 2), BLOCK):  # blocks overlap by two bytes
                    h = _trigrams(data[i : i + BLOCK + 2])
                    at = np.arange(i, i + len(h))
                    row = np.searchsorted(off, at, "right") - 1
                    good = (h >= 0) & (at + 2 < off[row + 1])
                    row, h = row[good], h[good]
                    if not len(row):
                        continue
                    first, many = int(row[0]), int(row[-1] - row[0]) + 1
                    seen[first : first + many] += np.bincount(row - first, minlength=many)
                    for m in range(k):
                        out[first : first + many, m] += np.bincount(row - first, logs[m][h], minlength=many)
                out *= (WEIGHT * np.minimum(1, LONGEST / np.maximum(seen, 1)))[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * k), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), declared, pa.array(seen.astype(np.int64)), flat], ["row_id", "address", "declared", "n_trigrams", "loglik"])

    return score


def _suggested(address: Column, langs: list[str]) -> Column:
    """The language that an address names: a leading label, a path part or the country suffix, in this order."""
    host = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    label, suffix = F.substring_index(host, ".", 1), F.substring_index(host, ".", -1)
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([A-Za-z]{2,3})(?:[/?#]|$)", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.lower(suffix))
    named = F.when(named.isin(langs), named)
    for c in (path, label):
        named = F.when(F.lower(c).isin(langs), F.lower(c)).otherwise(named)
    return named


def identify(rows: DataFrame, model: dict, id_col: str, text_col: str, address_col: str | None = None, host_col: str | None = None, declared_col: str | None = None, markup: bool = False) -> DataFrame:
    """row_id, lang, confidence, text_lang, n_trigrams for every row.

    ``host_col`` stands in for the address where rows have none. With ``markup`` texts are pages, whose tags are
    taken off and whose declared language is read.
    """
    langs = model["langs"]
    none = F.lit(None).cast("string")
    address = F.col(address_col) if address_col else F.col(host_col) if host_col else none
    picked = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), F.lower(F.col(declared_col)).alias("declared") if declared_col else none.alias("declared"), address.cast("string").alias("address"))
    if not langs:
        return picked.select("row_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), F.lit(0).cast("long").alias("n_trigrams"))
    first = picked.mapInArrow(_likelihoods(model, markup), "row_id long, address string, declared string, n_trigrams long, loglik array<double>")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("address"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit("")) if address_col else F.coalesce(F.col("address"), F.lit(""))
    best = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("loglik", F.array_max("loglik")).cast("int"))
    first = first.withColumn("host", host).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("text_lang", F.when(F.col("n_trigrams") > 0, best))
    first = staged(first, "lang-likelihoods")

    def counts(*keys: str) -> DataFrame:
        return first.groupBy(*keys).agg(F.array(*[F.count_if(F.col("text_lang") == x).cast("double") for x in langs]).alias("n"), F.count("*").alias("rows"))

    def smoothed(n: str, prior: str, strength: float) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, v: a + v) + strength
        return F.zip_with(n, prior, lambda v, p: (v + strength * p) / total)

    everywhere = counts().withColumn("flat", F.array_repeat(F.lit(1.0 / len(langs)), len(langs))).select(smoothed("n", "flat", float(len(langs))).alias("all"))
    by_domain = counts("domain").crossJoin(F.broadcast(everywhere)).select("domain", smoothed("n", "all", DOMAIN_STRENGTH).alias("domain_prior"))  # one row is broadcast
    by_host = counts("host", "domain").join(by_domain, "domain")
    by_host = staged(by_host.select("host", smoothed("n", "domain_prior", HOST_STRENGTH).alias("prior"), "rows"), "lang-priors")

    def through(said: Column, right: float) -> Column:
        """Log-probability of what was said under each language; nothing where no known language was named."""
        wrong = (1 - right) / max(1, len(langs) - 1)
        return F.array(*[F.when(said.isin(langs), F.when(said == x, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(max(wrong, 1e-6)))))).otherwise(F.lit(0.0)) for x in langs])

    # Few hosts can be hot, and theirs are broadcast, so no task gathers the rows of one.
    hot = first.join(F.broadcast(by_host.where(F.col("rows") > HOT).select("host", "prior")), "host", "left")
    cold = hot.where("prior is null").drop("prior").join(by_host.where(F.col("rows") <= HOT).select("host", "prior"), "host")
    joined = hot.where("prior is not null").unionByName(cold)
    suggested = _suggested(F.col("address"), langs) if address_col else none
    logs = joined.withColumn("d", through(F.col("declared"), DECLARED_RIGHT)).withColumn("suggested", suggested).withColumn("a", through(F.col("suggested"), ADDRESS_RIGHT))
    post = F.zip_with(F.zip_with("loglik", "prior", lambda x, p: x + F.log(p)), F.zip_with("d", "a", lambda x, y: x + y), lambda x, y: x + y)
    logs = logs.withColumn("post", post).withColumn("top", F.array_max("post"))
    sure = 1 / F.aggregate("post", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    chosen = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("post", F.col("top")).cast("int"))
    any_evidence = (F.col("n_trigrams") > 0) | F.col("declared").isin(langs) | F.col("suggested").isNotNull()
    return logs.select("row_id", F.when(any_evidence, chosen).alias("lang"), F.when(any_evidence, sure).alias("confidence"), "text_lang", "n_trigrams")
