"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans. The method adds spans of kind ``random``: runs of 20 characters and more from the
base64 alphabet whose log-likelihood under the model of random strings exceeds that under the model of ordinary
identifiers by ``MARGIN`` a character, and that touch no base span. Both are first-order models over characters,
trained from labelled samples: the random side on the secrets that the patterns find in a bounded sample of rows
and on strings drawn by a seeded rule, the ordinary side on the sample's words.

Nulls: a null text is empty. Offsets count code points. Rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Rows that the models are trained on, picked by a hash; all of their text counts.
SAMPLE = 500
MARGIN = 0.5
#: The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = {c: i for i, c in enumerate(ALPHABET)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: The index of each byte in the alphabet; any other parts strings.
_CODES = np.full(256, len(ALPHABET))
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def _pairs(strings: list[str]) -> np.ndarray:
    """How often each character follows each (last row: stands at the start)."""
    n = len(ALPHABET)
    codes = _CODES[np.frombuffer(" ".join(["", *strings]).encode(), np.uint8)]
    last, here = codes[:-1], codes[1:]
    return np.bincount((last * n + here)[here < n], minlength=(n + 1) * n).reshape(n + 1, n)


def _logs(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of characters after characters, drawn towards those of characters alone."""
    alone = pairs.sum(axis=0) + 0.5
    alone /= alone.sum()
    return np.log((pairs + 5 * alone) / (pairs.sum(axis=1, keepdims=True) + 5))


def _model(positives: np.ndarray, negatives: np.ndarray) -> np.ndarray:
    rule = random.Random(7)
    shapes = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64])
    drawn = ["".join(rule.choice(shapes[i % 4]) for _ in range(rule.randint(20, 48))) for i in range(2000)]
    return _logs(positives + _pairs(drawn)) - _logs(negatives)


def train(positives: list[str], negatives: list[str]) -> np.ndarray:
    """Log-likelihood ratios of each character after each (the last row: at the start), random over ordinary."""
    return _model(_pairs(positives), _pairs(negatives))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Train on a bounded sample of rows, whole texts; only counts of character pairs reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                secrets = [s for a, k, b in spans for s in IDENTIFIER.findall((ASSIGN.search(text, a)[2] if k == 0 else text[a:b]))]
                rest, at = [], 0
                for a, _, b in spans:  # in order; they may overlap
                    rest.append(text[at:a] if at < a else "")
                    at = max(at, b)
                sums += np.stack((_pairs(secrets), _pairs(IDENTIFIER.findall(" ".join([*rest, text[at:]])))))
        yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in sums], ["secrets", "ordinary"])

    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("text is not null")
    sums = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)), np.int64)
    for r in sampled(texts, sample, "id").select("text").mapInArrow(count, "secrets array<long>, ordinary array<long>").collect():
        sums += np.array([r.secrets, r.ordinary]).reshape(sums.shape)
    return _model(*sums)


def ratio(s: str, model: np.ndarray) -> float:
    """Log-likelihood ratio a character of the string being random."""
    at = np.array([_INDEX[c] for c in s])
    return float((model[len(ALPHABET), at[0]] + model[at[:-1], at[1:]].sum()) / len(at))


def all_spans(text: str, model: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans. Runs and base spans are met in one sweep, both in the order of their starts."""
    base = base_spans(text)
    more, i = [], 0
    reach = 0  # the furthest end of the base spans that start before the run's end
    for m in RUN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and ratio(m[0], model) > MARGIN:
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", model)
                for k in range(3):
                    out[k].append(sum(x[1] == k for x in base))
                out[3].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                out[4].append(_listed(spans))
                out[5].append(len(spans) - len(base))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
