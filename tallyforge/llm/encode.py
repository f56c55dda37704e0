"""Problem 7: token ids of whole texts by a public byte-level vocabulary.

Distinct pieces are inserted into a trie and walked depth first. The state of a trie node is the last token of the encoding of its
prefix: the one token t that ends the prefix and whose own predecessor, the last token of the rest, would not merge with it. A
shared prefix is thus encoded once for all pieces below it, and the ids of a piece are read back along its last tokens. Sorting the
pieces by their bytes visits the trie depth first, so the stack of states of one path is all that is held. Each partition walks its
own trie: nothing is shuffled, and what a worker keeps is bounded.

Defined results: null and empty texts have the empty list; strings of special tokens are ordinary text; texts are read whole and
rows stay rows, repeats included.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value of the vocabulary's publisher: how text is split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 400_000
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class TrieEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The plain definition: merge the adjacent pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together; before -1: whether the token stays itself."""
        got = self.fits.get((before, token))
        if got is None:
            want = [token] if before < 0 else [before, token]
            got = self.fits[before, token] = self.merged(b"".join(self.bytes[t] for t in want)) == want
        return got

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        out, path, last = {}, b"", [-1]  # last[i]: the last token of the first i bytes of the path
        for data, piece in sorted((p.encode(), p) for p in pieces):
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - self.longest), end):
                    token = self.ranks.get(data[start:end])
                    if token is not None and self.follows(last[start], token):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, ids, end = data, [], len(data)
            while end:
                ids.append(last[end])
                end -= len(self.bytes[last[end]])
            out[piece] = tuple(reversed(ids))
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, offsets)."""
        split = [self.split(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.kept}
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept = {}
            new = {p for pieces in split for p in pieces}
        self.kept |= self.encode_pieces(list(new))
        ids, sizes, kept = [], np.zeros(len(texts) + 1, np.int32), self.kept
        for i, pieces in enumerate(split):
            for p in pieces:
                ids += kept[p]
            sizes[i + 1] = len(ids)
        return np.array(ids, np.int32), sizes


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """A rank file of about 50,000 entries, read on the driver and broadcast: 1 MB whatever the corpus."""
    with open(path or os.environ.get("TOKENIZER_RANKS", DEFAULT), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _ranks(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(keep..., ids)."""
    ranks = _ranks(df.sparkSession, path)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        coder = TrieEncoder(ranks.value)
        for b in batches:
            ids, offsets = coder.encode_batch(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [*keep, "ids"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, f"{schema}, ids array<int>")


def token_counts(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(keep..., tokens): the lengths alone, so that the ids never leave the worker."""
    ranks = _ranks(df.sparkSession, path)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        coder = TrieEncoder(ranks.value)
        for b in batches:
            _, offsets = coder.encode_batch(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(np.diff(offsets).astype(np.int32))], [*keep, "tokens"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, f"{schema}, tokens int")
