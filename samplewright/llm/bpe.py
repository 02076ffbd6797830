"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

Pair occurrence index. The different pre-tokens of a partition are laid out in one array as linked
lists of bytes, and an index maps every mergeable pair to all its positions. Ranks that occur are
taken in ascending order (a merge can only create pairs of higher rank, as its result is the newest
token), each is applied at all its positions at once, and the lists of the neighbouring pairs are
updated. Every pre-token is merged once a partition, however often it occurs.

Defined cases: null and empty texts give an empty list; every row comes out once, repeated ids
included; texts of any length are encoded whole; strings of special tokens are ordinary text; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samplewright.session import parallel

#: Folder of the public vocabularies; a parameter everywhere, this is its default.
TOKENIZERS = os.environ.get("SAMPLEWRIGHT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters taken at once, and pre-tokens remembered, by one Python worker.
CHARS, REMEMBER = 2_000_000, 300_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class PairIndexEncoder:
    """Merges pre-tokens of one vocabulary by the pair occurrence index."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in _byte_letters()], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([ids[a] << 20 | ids[b] for a, b in merges], dtype=np.int64)
        self.left, self.right = (pairs >> 20).astype(np.int32), (pairs & 0xFFFFF).astype(np.int32)
        self.result = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        self.order = np.argsort(pairs)
        self.sorted = pairs[self.order]
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has no merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where(self.sorted[at] == key, self.order[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and the offset of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        token = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        count = len(token)
        ends = np.cumsum(size)
        following = np.arange(1, count + 1)
        following[ends[size > 0] - 1] = -1
        before = np.arange(-1, count - 1)
        before[(ends - size)[size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            rank = self._ranks(token[at], token[following[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(group)

        note(np.flatnonzero(following >= 0))
        while active:
            rank = heapq.heappop(active)
            groups = index.pop(rank)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            a, b = self.left[rank], self.right[rank]
            nxt = following[at]
            live = (token[at] == a) & (nxt >= 0)
            live[live] = token[nxt[live]] == b
            at = at[live]
            if a == b and len(at) > 1:  # of overlapping places, every other one from the left
                fresh = np.r_[True, following[at[:-1]] != at[1:]]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            after = following[gone]
            token[at] = self.result[rank]
            token[gone] = -1
            following[at] = after
            before[after[after >= 0]] = at[after >= 0]
            prior = before[at]
            note(np.concatenate([prior[prior >= 0], at[after >= 0]]))
        alive = token >= 0
        kept = np.r_[0, np.cumsum(alive)]
        return token[alive], np.r_[0, kept[ends]] if len(ends) else np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and len(texts) + 1 offsets."""
        if len(self.known) > REMEMBER:
            self.forget()
        known, split = self.known, self.split
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = split(text)
                counts[i] = len(found)
                pieces += found
        new = [w for w in dict.fromkeys(pieces) if w not in known]
        if new:
            ids, offsets = self.merge(new)
            known.update(zip(new, range(len(self.start) - 1, len(self.start) - 1 + len(new)), strict=True))
            self.start = np.r_[self.start, self.start[-1] + offsets[1:]]
            self.flat = np.r_[self.flat, ids]
        word = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        first, size = self.start[word], self.start[word + 1] - self.start[word]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.arange(total) + np.repeat(first - (ends - size), size)]
        return out, np.r_[0, ends][np.r_[0, np.cumsum(counts)]]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cut a batch so that one run has about CHARS characters, one text at least."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or "") > CHARS:
            yield begin, i
            begin, held = i, 0
        held += len(text or "")
    yield begin, len(texts)


def _over_batches(vocabulary: str, finish):
    """A mapInArrow function that hands (ids column, token ids, offsets) of each run to ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PairIndexEncoder(vocabulary)
            texts = batch.column(1).to_pylist()
            for a, b in _runs(texts) if texts else ():
                yield finish(batch.column(0).slice(a, b - a), *encoder.encode(texts[a:b]))

    return run


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids`` of every row."""

    def finish(key: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return parallel(documents.select("doc_id", "text"), 1).mapInArrow(_over_batches(f"{tokenizers}/byte_bpe_50k.json", finish), f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens`` of every row."""

    def finish(key: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return parallel(documents.select("doc_id", "text"), 1).mapInArrow(_over_batches(f"{tokenizers}/byte_bpe_50k.json", finish), f"doc_id {kind}, n_tokens bigint")
