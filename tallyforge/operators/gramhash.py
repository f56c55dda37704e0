"""N-grams as 64-bit hashes in Arrow batches, and a sieve that drops grams which another table lacks before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a sieve for each gram in it, as a power of two, and the greatest power of two of a whole sieve (128 MB).
SPARE_BITS, MOST_BITS = 3, 30
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _lists(row: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, in the order of their rows, as n lists."""
    off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column; a null list is empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), column.flatten().to_numpy(zero_copy_only=False)


def _window_hashes(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of n token hashes, by row and hash."""
    row, v = _flat(column)
    k = len(v) - n + 1
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v, h, p = v.view(np.uint64), np.zeros(k, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(n):
            p = p * _MIX
            h += v[i : i + k] * p
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    whole = row[:k] == row[n - 1 :]
    row, h = row[:k][whole], h[whole].view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _cells(h: np.ndarray, power: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)


def power(grams: int) -> int:
    """The size of a sieve of so many grams, as a power of two."""
    return min(MOST_BITS, max(16, int(grams).bit_length() + SPARE_BITS))


def sieve(df: DataFrame, power: int) -> DataFrame:
    """(slice, bits): the cells of df's column grams, 65,536 to a slice. What is shuffled is two bytes a gram."""

    def cells(batches):
        for b in batches:
            c = np.unique(_cells(_flat(b.column("grams"))[1], power))
            at, start = np.unique(c >> 16, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([x.tobytes() for x in np.split((c & 0xFFFF).astype(np.uint16), start[1:])] if len(at) else [], pa.binary())], ["slice", "low"])

    def merged(batches):
        for b in batches:
            out = []
            for low in b.column("low").to_pylist():
                bits = np.zeros(1 << 16, bool)
                for x in low:
                    bits[np.frombuffer(x, np.uint16)] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(out, pa.binary())], ["slice", "bits"])

    return df.select("grams").mapInArrow(cells, "slice int, low binary").groupBy("slice").agg(F.collect_list("low").alias("low")).mapInArrow(merged, "slice int, bits binary")


def _loaded(tables, power: int) -> np.ndarray:
    bits = np.zeros((1 << (power - 16), 1 << 13), np.uint8)
    for t in tables:
        for at, x in zip(t.column("slice").to_pylist(), t.column("bits").to_pylist(), strict=True):
            bits[at] = np.frombuffer(x, np.uint8)
    return bits.reshape(-1)


def _kept(h: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    c = _cells(h, power)
    return (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1


def hashed(df: DataFrame, n: int, tables=None, power: int = 0) -> DataFrame:
    """df: (id, size, toks), toks the hashes of the tokens: (id, size, grams). tables: reads a sieve's files; grams outside it are left out."""

    def run(batches):
        bits = _loaded(tables(), power) if tables else None
        for b in batches:
            row, h = _window_hashes(b.column("toks"), n)
            if tables:
                keep = _kept(h, bits, power)
                row, h = row[keep], h[keep]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), _lists(row, h, b.num_rows, pa.int64())], ["id", "size", "grams"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, size int, grams array<bigint>")


def sieved(df: DataFrame, tables, power: int) -> DataFrame:
    """(id, size, grams) without the grams outside the sieve."""

    def run(batches):
        bits = _loaded(tables(), power)
        for b in batches:
            row, h = _flat(b.column("grams"))
            keep = _kept(h, bits, power)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), _lists(row[keep], h[keep], b.num_rows, pa.int64())], ["id", "size", "grams"])

    return df.mapInArrow(run, df.schema)


def parted(df: DataFrame, tables) -> DataFrame:
    """(id, size, common, rare): which of the listed grams a record has, by their places in the list, and its other grams. tables: reads the list's files (place, g)."""

    def run(batches):
        listed = [t.select(["g", "place"]) for t in tables()]
        g = np.concatenate([t.column("g").to_numpy() for t in listed]) if listed else np.zeros(0, np.int64)
        place = np.concatenate([t.column("place").to_numpy() for t in listed]).astype(np.int16) if listed else np.zeros(0, np.int16)
        order = np.argsort(g)
        g, place = g[order], place[order]
        for b in batches:
            row, h = _flat(b.column("grams"))
            at = np.minimum(np.searchsorted(g, h), max(0, len(g) - 1))
            common = g[at] == h if len(g) else np.zeros(len(h), bool)
            row_c, c = row[common], place[at[common]] if len(g) else np.zeros(0, np.int16)
            by = np.lexsort((c, row_c))
            cols = [b.column("id"), b.column("size"), _lists(row_c[by], c[by], b.num_rows, pa.int16()), _lists(row[~common], h[~common], b.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "size", "common", "rare"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, size int, common array<smallint>, rare array<bigint>")


def two_best(df: DataFrame, tables, id_type: str) -> DataFrame:
    """df: (kind, common). (kind, n, b): of the rows (id, common) of each file the two that share most places, the smaller id first. tables: reads those files."""

    def run(batches):
        for batch in batches:
            row, c = _flat(batch.column("common"))
            mine = np.split(c, np.cumsum(np.bincount(row, minlength=batch.num_rows))[:-1])
            for t in tables():
                t = t.combine_chunks().sort_by("id")
                r, places = _flat(t.column("common").combine_chunks())
                by = np.argsort(places, kind="stable")
                r, ends = r[by], np.searchsorted(places[by], np.arange(int(places.max(initial=0)) + 2))
                kinds, counts, ids = [], [], []
                for i, own in enumerate(mine):
                    near = [r[ends[p] : ends[p + 1]] for p in own if p + 1 < len(ends)]
                    if not near:
                        continue
                    n = np.bincount(np.concatenate(near), minlength=t.num_rows)
                    for _ in range(2):
                        j = int(n.argmax())  # of equal counts the first, so the smallest id
                        if n[j]:
                            kinds.append(i), counts.append(int(n[j])), ids.append(j)
                            n[j] = 0
                at = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("kind").take(pa.array(kinds, pa.int64())), pa.array(counts, pa.int64()), t.column("id").combine_chunks().take(at)], ["kind", "n", "b"])

    return df.mapInArrow(run, f"kind bigint, n bigint, b {id_type}")
