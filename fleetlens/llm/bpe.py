"""Byte-level BPE: encoding and decoding by a file of ranks.

Two tiers resolve a pre-token. A minimal perfect hash finds those that are in the
vocabulary as a whole; the others are merged by a heap of pairs over a doubly
linked list of their bytes. Texts repeat their words, so a Python worker keeps the
ids of the words it has met, up to a fixed number.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import re
import regex
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm import common

#: A space before white space, or at the end: only then do words depend on what surrounds them.
_UNEVEN = re.compile(r" (?:\s|$)")
#: Odd constants that spread a displacement over 64 bits.
_SHIFT, _MIX, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64 - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ids, which count from zero."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must count from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of distinct keys, by hashing and displacing.

    Keys are hashed into buckets. The fullest buckets come first; each looks for
    a displacement that puts all its keys into free slots. A bucket of one key
    names its slot directly, so all slots are used.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.size = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        hashes = np.array([xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        taken, slots = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
        shift = [0] * self.buckets
        groups.sort(key=len, reverse=True)
        for group in groups:
            if len(group) == 1:
                continue
            for low in range(0, 1 << 22, 256):
                shifts = np.arange(low, low + 256, dtype=np.uint64)[:, None] * np.uint64(_SHIFT)
                tried = (((hashes[group] ^ shifts) * np.uint64(_MIX) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                apart = (np.diff(np.sort(tried, axis=1), axis=1) > 0).all(axis=1)
                fits = np.flatnonzero(apart & ~taken[tried].any(axis=1))
                if len(fits):
                    slots[group] = tried[fits[0]]
                    taken[slots[group]] = True
                    shift[bucket[group[0]]] = low + int(fits[0])
                    break
            else:
                raise ValueError("no displacement found: are the keys distinct?")
        free = iter(np.flatnonzero(~taken).tolist())
        for group in groups:
            if len(group) == 1:
                slots[group] = next(free)
                shift[bucket[group[0]]] = -1 - int(slots[group[0]])
        self.shift = shift
        self.ids = np.argsort(slots).tolist()
        self.keys = [keys[i] for i in self.ids]

    def get(self, key: bytes) -> int | None:
        """The key's position in the list of keys; None for any other key."""
        h = xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -1 - d if d < 0 else (((h ^ d * _SHIFT & _WORD) * _MIX & _WORD) >> 32) % self.size
        return self.ids[slot] if self.keys[slot] == key else None


class Vocabulary:
    """The ranks of a file, ready to encode and decode."""

    def __init__(self, path: str, pattern: str):
        self.name, self.pattern = path, pattern
        self.tokens = read_ranks(path)
        self.hash = PerfectHash(self.tokens)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens)}  # of parts, while merging

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: of neighbours whose joint bytes have the lowest rank, the leftmost merge first."""
        whole = self.hash.get(piece)
        if whole is not None:
            return [whole]
        rank, n = self.ranks.get, len(piece)
        # The part that starts at i: where it ends (n once it is merged away), and where the one before starts.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry holds a pair's rank, start and end, in this order, in one number.
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, stop = entry >> bits & mask, entry & mask
            middle = end[i]
            if middle == n or end[middle] != stop:
                continue  # one of its parts has been merged since
            end[i], end[middle] = stop, n
            if stop < n:
                before[stop], after = i, end[stop]
                if (r := rank(piece[i:after])) is not None:
                    heappush(heap, (r << bits | i) << bits | after)
            if (left := before[i]) >= 0 and (r := rank(piece[left:stop])) is not None:
                heappush(heap, (r << bits | left) << bits | stop)
        ids, i = [], 0
        while i < n:
            ids.append(rank(piece[i : end[i]]))
            i = end[i]
        return ids


class Memo:
    """Results by key, in two generations: the younger becomes the older when it is full, so what is used stays."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}
        self.long: list[str] = []

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.young[key] = got
        return got

    def put(self, key: str, value: bytes) -> None:
        """Long keys are remembered until the next ``age`` only, so that the entries bound the size."""
        self.young[key] = value
        if len(key) > common.MEMO_CHARS:
            self.long.append(key)

    def age(self) -> None:
        for key in self.long:
            self.young.pop(key, None)
        self.long.clear()
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young


class Encoder:
    """Texts to little-endian unsigned 32-bit ids.

    A single space before a character that isn't white space always starts a
    pre-token. So the words between such spaces are encoded apart, and each
    distinct word once.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.find, self.merge = regex.compile(vocabulary.pattern).findall, vocabulary.merge
        self.words, self.pieces = Memo(common.MEMO_ENTRIES), Memo(2 * common.MEMO_ENTRIES)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text of a portion; what is remembered is bounded between portions."""
        split = [[] if _UNEVEN.search(text) else text.split(" ") for text in texts]
        self.learn(set().union(*[words[1:] for words in split]))
        known = self.words.young
        made = [
            self.whole(words[0]) + b"".join([known[w] for w in words[1:]]) if words else self.whole(text)
            for text, words in zip(texts, split)
        ]
        self.words.age()
        self.pieces.age()
        return made

    def learn(self, words: set[str]) -> None:
        """Ids of words with the space before them; one search finds the pre-tokens of all new ones."""
        new = [w for w in words if self.words.get(w) is None]
        at, ids = -1, []
        for piece in self.find(" " + " ".join(new)) if new else ():
            if piece[0] == " ":  # no word holds a space
                if ids:
                    self.words.put(new[at], b"".join(ids))
                at, ids = at + 1, []
            ids.append(self.piece(piece))
        if ids:
            self.words.put(new[at], b"".join(ids))

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.find(text)))

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            ids = self.merge(piece.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
            self.pieces.put(piece, got)
        return got


_encoders: dict[tuple[str, str], Encoder] = {}


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, as little-endian unsigned 32-bit integers in a binary column.

    ``path`` is a rank file on the driver, ``pattern`` finds the pre-tokens; each
    is encoded apart and no special tokens are made. A row per row: repeated and
    null ids are kept, a null text is an empty one and has no ids. Other columns
    are left out, whatever their names. The vocabulary, which does not grow with
    the data, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        key = (vocabulary.name, vocabulary.pattern)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(vocabulary))
        for ids, texts in common.portions(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(encoder.encode_all(texts), pa.binary())], ["doc_id", "ids"])

    texts = common.id_and_text(docs)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the ``bytes`` that the ids stand for; null ids give null bytes.

    An id that the file does not have raises.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]
            made = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["doc_id", "ids", "bytes"])

    encoded = encoded.select("doc_id", "ids")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return decode(encode(docs, path, pattern), path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
