"""Operator 9: packing documents into token sequences by best-fit decreasing.

A document longer than the window is first cut into full windows, which are
sequences of their own; what is left of every document is packed by best-fit
decreasing: the tightest open sequence is found in a segment tree indexed by
remaining capacity. Packing runs in hash buckets of about BUCKET pieces, so no
task packs the whole corpus; a bucket leaves about one sequence half empty.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.llm.text import whole
from papersluice.session import read_table, written

WINDOW = 2048
#: The id after each document.
END = 1
#: Pieces packed together.
BUCKET = 2048
#: Vocabulary file of tokenizers, by its name in public_tokenizers or by its path.
VOCABULARY = "byte_bpe_50k.json"
#: Distinct chunks of text whose ids a worker remembers, twice so many at most, and the most characters of one.
REMEMBERED, LONGEST = 700_000, 64
#: Texts whose new chunks are encoded together.
TOGETHER = 256

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def load_tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))


class IdBytes:
    """Texts to their ids as little-endian unsigned 32-bit numbers.

    The pre-tokenizer always cuts before a blank between two characters that
    are no white space, and added tokens hold no blank, so a text's ids are
    those of the chunks between such cuts, and the ids of chunks are
    remembered: of two generations the older is forgotten when the younger is
    full. Chunks keep all other white space.
    """

    def __init__(self, vocabulary: str = VOCABULARY, remembered: int = REMEMBERED):
        self.tokenizer, self.known, self.older, self.most = load_tokenizer(vocabulary), {}, {}, remembered
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(r"\s (?:\s|\Z)").search
        self.cuts = re.compile(r"(?<=\S) (?=\S)").split

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The first chunk of a text stands for itself, the others follow a blank."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        parts = [self.cuts(t) if self.odd(t) or any(a in t for a in self.added) else t.split(" ") for t in texts]
        starts = [p.pop(0) for p in parts]
        heads = list(set(starts))
        new = [c for c in set().union(*parts) if c not in known]
        known.update((c, older[c]) for c in new if c in older)
        chunks = [c for c in new if c not in known]
        coded = self._fresh([*heads, *(f" {c}" for c in chunks)])
        first = dict(zip(heads, coded, strict=False))
        known.update(zip(chunks, coded[len(heads) :], strict=True))
        out = [first[start] + b"".join(map(known.__getitem__, p)) for start, p in zip(starts, parts, strict=True)]
        for c in chunks:
            if len(c) > LONGEST:
                del known[c]
        return out


@lru_cache(maxsize=2)
def id_bytes(vocabulary: str) -> IdBytes:
    """One for all tasks of a worker."""
    return IdBytes(vocabulary)


def _pieces_of(rows: Iterator[pd.DataFrame], text: str, window: int, end: int, vocabulary: str, keep_ids: bool) -> Iterator[pd.DataFrame]:
    ids_of, tail = id_bytes(vocabulary), np.array([end], "<u4").tobytes()
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in rows:
        for lo in range(0, len(batch), TOGETHER):
            part = batch.iloc[lo : lo + TOGETHER]
            at, cut = [], []
            for k, coded in enumerate(ids_of([t or "" for t in part[text]])):
                ids = memoryview(coded + tail)
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    at.append(k)
                    cut.append((start, len(piece) // 4, zlib.crc32(piece), n, np.frombuffer(piece, "<i4") if keep_ids else None))
            out = part.drop(columns=[text]).iloc[at].reset_index(drop=True)
            for name, values in zip(("start", "length", "ids_crc32", "doc_tokens", "ids"), zip(*cut, strict=True), strict=True):
                if name != "ids" or keep_ids:
                    out[name] = list(values)
            out["_number"] = np.arange(number, number + len(out))
            number += len(out)
            yield out


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens (and ids, if asked), _number: full windows and what is left of each document.

    _number tells pieces apart that are equal in all else; it is stable once the table is written.
    """
    schema = docs.select(key).schema.simpleString()[len("struct<") : -1] + ", " + PIECES + (", ids array<int>" if keep_ids else "") + ", _number long"
    named = docs.select(key, whole(text).alias("_text"))
    return named.mapInPandas(lambda rows: _pieces_of(rows, "_text", window, end, vocabulary, keep_ids), schema)


class OpenSequences:
    """Open sequences by remaining capacity, with a segment tree over the capacities to find the least one that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _set(self, capacity: int, value: bool) -> None:
        some, i = self.some, capacity + self.leaves
        while i and some[i] != value:
            some[i] = value
            i //= 2
            if not value and i and (some[2 * i] or some[2 * i + 1]):
                break

    def put(self, capacity: int, sequence: int, used: int) -> None:
        self.stacks[capacity].append((sequence, used))
        self._set(capacity, True)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(capacity, sequence, used) of a tightest open sequence with that much room."""
        some, i = self.some, least + self.leaves
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if some[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        stack = self.stacks[capacity]
        sequence, used = stack.pop()
        if not stack:
            self._set(capacity, False)
        return capacity, sequence, used


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, longest first; equal lengths in their order."""
    open_, sequences, offsets, n = OpenSequences(window), [0] * len(lengths), [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = open_.take(lengths[k])
        if found is None:
            found, n = (window, n, 0), n + 1
        capacity, sequences[k], offsets[k] = found
        if capacity > lengths[k]:
            open_.put(capacity - lengths[k], sequences[k], offsets[k] + lengths[k])
    return sequences, offsets


def pack(pieces: DataFrame, key: str = "doc_id", window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """pieces (a written table, with _number) with sequence_id and offset.

    sequence_id is the bucket times 2^32 plus a number within it; offsets have
    no gaps. Every piece is in one sequence. Pieces are dealt by their numbers,
    so documents with null or repeated keys and repeated rows are packed like
    others and share no bucket. An empty table gives an empty result.
    """
    buckets = max(1, -(-pieces.count() // bucket))
    columns = [c for c in pieces.columns if c != "_number"]

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in (key, "start", "ids_crc32", "_number") if c in rows], kind="stable").reset_index(drop=True)
        number = int(rows["_bucket"].iloc[0])
        sequences, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        out = rows[columns].copy()
        out["sequence_id"] = np.asarray(sequences, dtype="int64") + (number << 32)
        out["offset"] = np.asarray(offsets, dtype="int64")
        return out

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_number"), F.lit(buckets)))
    schema = pieces.select(*columns).schema.simpleString()[len("struct<") : -1] + ", sequence_id long, offset long"
    return dealt.groupBy("_bucket").applyInPandas(place, schema)


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents cut and packed: per piece the columns of token_pieces(), sequence_id and offset.

    A null text is an empty one (its only id is the end). Very long texts make
    as many pieces as they need. Repeated rows and null or repeated keys are
    packed each; columns other than key and text don't matter, whatever their names.
    """
    return pack(written(token_pieces(docs, **options), "pieces"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; nulls, empty and very long texts, repeated rows as in packed_documents()."""
    return packed_documents(read_table(spark, sf_dir, "documents"))
