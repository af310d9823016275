"""Byte-level BPE over a whole corpus; merges found by a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Pieces kept per worker, and the longest piece kept; both only save time.
CACHE_PIECES, CACHE_CHARS = 1 << 17, 48
_NONE = 1 << 62
_PLACE = (1 << 40) - 1

#: Fixed value of the vocabulary: how it cuts text before merging. White space is the Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_letters() -> dict[str, int]:
    """The vocabulary's letter of every byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and merges of a byte-level BPE file; ``ids`` encodes a text without special tokens."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.merged: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merged[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.find = regex.compile(PIECES).findall
        self.cache: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece.encode())
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def piece(self, raw: bytes) -> list[int]:
        """Merge one piece. Leaf i of the tree holds (rank, i) of the pair that starts at i; its root is the leftmost pair of lowest rank."""
        of_byte, merged = self.of_byte, self.merged
        tok = [of_byte[b] for b in raw]
        n = len(tok)
        if n < 2:
            return tok
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            hit = merged.get(tok[i] << 32 | tok[i + 1])
            if hit:
                tree[size + i] = hit[0] << 40 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        alive = bytearray(b"\1") * n
        while (root := tree[1]) < _NONE:
            i = root & _PLACE
            j = after[i]
            tok[i] = merged[tok[i] << 32 | tok[j]][1]
            alive[j] = 0
            k = after[i] = after[j]
            if j < n - 1:
                put(j, _NONE)
            hit = None
            if k < n:
                before[k] = i
                hit = merged.get(tok[i] << 32 | tok[k])
            put(i, hit[0] << 40 | i if hit else _NONE)
            if (p := before[i]) >= 0:
                hit = merged.get(tok[p] << 32 | tok[i])
                put(p, hit[0] << 40 | p if hit else _NONE)
        return [t for t, there in zip(tok, alive, strict=True) if there]


@lru_cache(maxsize=4)
def _loaded(content: bytes) -> Bpe:
    return Bpe(content)


def _vocabulary(df: DataFrame, tokenizer: str, folder: str):
    """The file's bytes (1.6 MB, a fixed size) as a broadcast, so that executors need no copy of the folder."""
    with open(os.path.join(folder, f"{tokenizer}.json"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)`` of every row: token ids of the whole text, no special tokens.

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary
    text. Rows keep their multiplicity, a null key stays null. One pass, no shuffle; the time of
    a piece of n bytes grows as n log n, so very long runs are no trouble.
    """
    content = _vocabulary(df, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content.value)
        for batch in batches:
            ids = [bpe.ids(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    picked = df.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col(f"`{text}`"))
    return picked.mapInArrow(run, f"`{key}` bigint, ids array<int>")


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` and the number of tokens of its text column (0 for null and empty)."""
    content = _vocabulary(df, tokenizer, folder)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        bpe = _loaded(content.value)
        return pa.array([len(bpe.ids(t)) for t in texts.to_pylist()], pa.int32())

    return df.withColumn(out, count(F.col(f"`{text}`")))
