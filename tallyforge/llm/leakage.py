"""Problem 5: passages of test items inside training text, by winnowing.

Texts are words in lower case. Of every window of `least - k + 1` consecutive k-grams the one with the smallest hash is kept, on
both sides, so each shared span of `least` words has a fingerprint in common. Fingerprints are joined, and the hits are extended
word by word on the texts themselves; a record leaks an item where a run of at least `least` words is shared.

Defined results: null, empty and short texts leak nothing; null ids are ignored; repeats count once; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import WORD
from tallyforge.session import Scratch

_WORD = regex.compile(WORD)
#: Test fingerprints up to this number are broadcast (about 30 bytes each); beyond it the join shuffles.
BROADCAST_PRINTS = 500_000


def _grams(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the k-gram at each word, text of each word, place of each word in its text)."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = _WORD.findall(t.lower())
            sizes[i] = len(found)
            words += found
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, names = pd.factorize(np.array(words, object))
    h = pd.util.hash_array(np.asarray(names, object), categorize=False)[codes]
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = np.zeros(len(words), np.uint64)
    for m in range(k):
        gram[: len(words) - m] = gram[: len(words) - m] * np.uint64(0x9E3779B97F4A7C15) + h[m:]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    return gram, row, place


def _winnow(texts: list[str | None], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gram, row, place = _grams(texts, k)
    n, last = len(gram), window + k - 2  # a window begins where so many words follow in its text
    if n <= last:
        return gram[:0], row[:0], place[:0]
    starts = np.flatnonzero(row[: n - last] == row[last:])
    best, least = starts.copy(), gram[starts]
    for m in range(1, window):
        g = gram[starts + m]
        lower = g <= least  # the rightmost of equal ones, so that neighbouring windows agree
        best[lower], least[lower] = starts[lower] + m, g[lower]
    at = np.unique(best)
    return gram[at], row[at], place[at]


def fingerprints(df: DataFrame, ids: list[str], text: str, k: int, window: int) -> DataFrame:
    """(ids..., print, pos)."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches):
        for b in batches:
            gram, row, place = _winnow(b.column(text).to_pylist(), k, window)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ids], pa.array(gram.view(np.int64)), pa.array(place.astype(np.int32))], [*ids, "print", "pos"])

    return df.select(*ids, text).mapInArrow(run, f"{schema}, print long, pos int")


def _extend(k: int, least: int, keep: list[str]):
    def run(batches):
        for b in batches:
            good, words = [], {}
            for i, (text, passage, hits) in enumerate(zip(b.column("text").to_pylist(), b.column("passage").to_pylist(), b.column("hits").to_pylist(), strict=True)):
                for t in (text, passage):
                    if t not in words:
                        words[t] = _WORD.findall(t.lower())
                x, y, done = words[text], words[passage], set()
                for h in hits:
                    p, q = h["pos"], h["item_pos"]
                    if (p - q, p) in done or x[p : p + k] != y[q : q + k]:
                        continue
                    low = 0
                    while p - low > 0 and q - low > 0 and x[p - low - 1] == y[q - low - 1]:
                        low += 1
                    high = k
                    while p + high < len(x) and q + high < len(y) and x[p + high] == y[q + high]:
                        high += 1
                    if low + high >= least:
                        good.append(i)
                        break
                    done.update((p - q, m) for m in range(p - low, p + high - k + 1))
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(good, pa.int64())) for c in keep], keep)

    return run


def leaks(texts: DataFrame, items: DataFrame, k: int = 5, least: int = 8) -> DataFrame:
    """texts: (record_kind, record_id, field, text); items: (item_id, passage). Returns (record_kind, record_id, field, item_id)."""
    scratch = Scratch(texts.sparkSession, "leaks")
    window = least - k + 1
    texts = texts.where("record_id IS NOT NULL AND text IS NOT NULL")
    items = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").distinct()
    own = scratch.keep(fingerprints(items, ["item_id"], "passage", k, window).select("item_id", "print", F.col("pos").alias("item_pos")))
    hint = F.broadcast if own.count() <= BROADCAST_PRINTS else (lambda d: d)
    record = ["record_kind", "record_id", "field"]
    found = fingerprints(texts, record, "text", k, window).join(hint(own), "print")
    hits = scratch.keep(found.groupBy(*record, "item_id").agg(F.collect_set(F.struct("pos", "item_pos")).alias("hits")))
    whole = hits.join(texts, record).join(items, "item_id")
    keep = [*record, "item_id"]
    schema = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in keep)
    return whole.select(*keep, "text", "passage", "hits").mapInArrow(_extend(k, least, keep), schema).distinct()


def leak_report(found: DataFrame) -> DataFrame:
    """Records, and fields of records, that leak each item."""
    return found.groupBy("item_id", "record_kind").agg(F.count_distinct("record_id").alias("records"), F.count("*").alias("fields"))
