"""Byte-level BPE encoding of whole corpora.

A text is cut by the tokenizer's pattern, each word's bytes are merged by rank. For a short word the
boundaries of its parts and the ranks of neighbouring parts lie in two contiguous arrays: the
minimum is found by a scan, its boundary deleted and the two neighbouring ranks refreshed. A
long word (past ``LONG`` bytes), where scans would cost the square of its length, is merged over a
linked list with a heap of ranks, which yields the same parts.

Words repeat, so each worker keeps the ids of pieces it has met, up to ``KEPT`` of them.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern the public byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
KEPT = 400_000
#: Longer pieces are not worth keeping.
KEPT_LENGTH = 48
_NONE = 1 << 60


class ByteBPE:
    """Ids of texts by a rank file (base64 token and rank a line); special tokens are plain text."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import regex

        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self._words = regex.compile(pattern).findall
        # A space between two non-spaces always starts a word, so pieces between such places can
        # be encoded, and kept, on their own.
        self._pieces = re.compile(r"(?<=\S)(?= \S)").split
        self._kept: dict[str, list[int]] = {}

    def _scan(self, word: bytes) -> list[int]:
        ranks = self.ranks
        bounds = list(range(len(word) + 1))
        pairs = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while pairs:
            low = min(pairs)
            if low == _NONE:
                break
            at = pairs.index(low)
            del bounds[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(word[bounds[at] : bounds[at + 2]], _NONE)
            if at:
                pairs[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], _NONE)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0:
                b = before[i]
                if (r := ranks.get(word[b:stop])) is not None:
                    heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def _piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for word in self._words(piece):
            raw = word.encode("utf-8", "surrogatepass")
            one = self.ranks.get(raw)
            if one is not None:
                ids.append(one)
            else:
                ids += self._scan(raw) if len(raw) <= LONG else self._heap(raw)
        if len(piece) <= KEPT_LENGTH:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for an empty or null one."""
        ids: list[int] = []
        if text:
            kept = self._kept.get
            for piece in self._pieces(text):
                ids += kept(piece) or self._piece(piece)
        return ids


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(vocabulary: str) -> ByteBPE:
    """The worker's own tokenizer, loaded once."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = ByteBPE(vocabulary)
    return _LOADED[vocabulary]


def _encode(vocabulary: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            if counts_only:
                made = pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            else:
                flat, ends = array("i"), array("q", [0])
                for text in batch.column(1):
                    flat.extend(encode(text.as_py()))
                    ends.append(len(flat))
                made = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["key", "made"])

    return run


def token_ids(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of each row; ids is an empty list where the text is null or empty. Rows are kept as they are, repeats included."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(_encode(vocabulary, False), f"key {kind}, made array<int>").select(F.col("key").alias(key), F.col("made").alias("ids"))


def token_counts(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row; 0 where the text is null or empty."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(_encode(vocabulary, True), f"key {kind}, made bigint").select(F.col("key").alias(key), F.col("made").alias("n_tokens"))
