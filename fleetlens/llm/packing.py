"""Packing documents into sequences of a fixed number of tokens.

Documents are tokenised and cut into pieces. Pieces that fill a sequence are one.
The others are packed by multiway differencing (Karmarkar-Karp): a block of pieces
starts as as many partial partitions into k windows; the two with the largest
spread are merged, the fullest windows of one with the emptiest of the other, until
one partition with nearly equal windows is left. If its fullest window exceeds the
capacity, k rises and the block is partitioned anew.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm import common
from fleetlens.llm.token_counts import byte_letters
from fleetlens.session import materialize

#: Pieces are packed in blocks of so many, each apart, so no task holds more at once.
BLOCK_PIECES = 1024
#: Cuts are rounded to the nearest id.
HALF = 0.5
#: Sequence numbers of a task start at its partition's number times this.
SEQUENCES_PER_TASK = 2**40
#: Numbers of sequences of gathered pieces begin here; blocks of them that a task packs.
GATHERED, BLOCKS_GATHERED = 2**62, 8

#: tiktoken keeps an entry per character of a white-space run and fails beyond about a million; longer runs than this don't go there.
SPACE_RUN = 100_000
SPACES = re.compile(r"\s+")

#: Fixed value: where a byte-level tokenizer splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def long_run(text: str) -> bool:
    """Whether more than SPACE_RUN characters of white space follow one another."""
    return len(text) > SPACE_RUN and any(m.end() - m.start() > SPACE_RUN for m in SPACES.finditer(text))


class Tokens:
    """Ids of texts by a byte-level tokenizer file.

    A file whose merges are numbered in the order in which they apply is a table of
    ranks, and ``tiktoken`` gives its ids in half the time. Texts with an added
    token's string or a very long run of white space go through the file's own
    library, which is loaded for the first one.
    """

    def __init__(self, file: str):
        import tiktoken

        self.file, spec = file, json.loads(file)
        level, model = spec["pre_tokenizer"], spec["model"]
        added = {t["content"] for t in spec["added_tokens"]}
        kind = (spec["normalizer"], level["type"], level["add_prefix_space"], level["use_regex"], model["type"])
        if kind != (None, "ByteLevel", False, True, "BPE"):
            raise ValueError("a tokenizer of another kind")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {
            bytes([byte[c] for c in letters]): rank for letters, rank in model["vocab"].items() if letters not in added
        }
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][m] != rank for rank, m in enumerate(merged, len(byte))):
            raise ValueError("ids must follow the order of the merges")
        self.by_rank = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or "(?!)")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file)

    def encode(self, text: str) -> bytes:
        if self.added.search(text) or long_run(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.by_rank.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def tokenizer_file(docs: DataFrame, path: str):
    """The text of a file on the driver, for all tasks."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def end_bytes(end_id: int) -> bytes:
    return np.array([end_id], dtype="<u4").tobytes()


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit ids of each whole text, then ``end_id``.

    ``path`` is a tokenizer file on the driver. A null text is an empty one and
    has ``end_id`` alone. The tokenizer lives as long as its task: Python workers
    are reused, and what they kept would stay in memory through later stages.
    """
    shared, end = tokenizer_file(docs, path), end_bytes(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for ids, texts in common.portions(batches):
            made = pa.array([tokens.encode(t) + end for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, made], ["doc_id", "ids"])

    texts = common.id_and_text(docs)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids binary")


def cuts(n: int, capacity: int, max_tail: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids.

    Every ``capacity`` ids from the start are one piece; what is left is cut into
    equal parts of at most ``max_tail`` ids. Without ids there is no piece.
    """
    tail = n % capacity
    parts = -(-tail // max_tail)
    edges = [n - tail + math.floor(tail / parts * i + HALF) for i in range(parts + 1)] if parts else []
    return [(start, capacity) for start in range(0, n - tail, capacity)] + [(a, b - a) for a, b in zip(edges, edges[1:])]


PIECE = ["doc_id", "start", "length", "ids", "doc_tokens"]


def pieces_of(
    batches: Iterator[pa.RecordBatch], tokens: Tokens, end: bytes, capacity: int, max_tail: int
) -> Iterator[pa.RecordBatch]:
    """The pieces of ``doc_id, text`` rows, at most BLOCK_PIECES at a time."""
    for ids, texts in common.portions(batches):
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            at, start, length, own, total = zip(*rows)
            longs = [pa.array(c, pa.int64()) for c in (start, length, total)]
            doc_ids = ids.take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([doc_ids, *longs[:2], pa.array(own, pa.binary()), longs[2]], PIECE)

        for i, text in enumerate(texts):
            whole = tokens.encode(text) + end
            n = len(whole) // 4
            for start, length in cuts(n, capacity, max_tail):
                rows.append((i, start, length, whole[4 * start : 4 * (start + length)], n))
                if len(rows) == BLOCK_PIECES:
                    yield made()
                    rows.clear()
        if rows:
            yield made()


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Partition of the sizes into ``k`` windows with nearly equal sums: each window's sum and members.

    A partial partition lists its non-empty windows, the fullest first.
    """
    order = itertools.count()
    parts = [(-size, next(order), [(size, [i])]) for i, size in enumerate(sizes)]
    heapify(parts)
    while len(parts) > 1:
        _, _, a = heappop(parts)
        _, _, b = parts[0]
        lone = k - len(b) if len(a) + len(b) > k else len(a)
        merged = a[:lone]
        # The emptiest windows of one join the emptiest of the other, in opposite order.
        pairs = len(a) - lone
        merged += b[: len(b) - pairs]
        for (x, own), (y, other) in zip(a[lone:], reversed(b[len(b) - pairs :])):
            merged.append((x + y, own + other))
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapreplace(parts, (-spread, next(order), merged))
    return parts[0][2] if parts else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of each window; no window holds more than ``capacity``, which no size exceeds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        made = difference(sizes, k)
        if not made or made[0][0] <= capacity:
            return [members for _, members in made]
        k += max(1, k // 200)


def placed(
    batches: Iterator[pa.RecordBatch], at: int, capacity: int, block: int = BLOCK_PIECES, gathered: bool = False
) -> Iterator[pa.RecordBatch]:
    """A task's pieces, their length in column ``at``, with ``sequence_id`` and ``offset``, block by block.

    What does not fill a block, but for pieces that fill a sequence, is left without a place; of ``gathered`` pieces
    all get one.
    """

    def packed(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        sizes = rows.column(at).to_pylist()
        if any(not 0 < s <= capacity for s in sizes):
            raise ValueError(f"a piece's length must be from 1 to {capacity}")
        order, sequence, offset = [], [], []
        whole = [[i] for i, s in enumerate(sizes) if s == capacity]
        rest = [i for i, s in enumerate(sizes) if s < capacity]
        full = gathered or not last
        for members in whole + [[rest[j] for j in w] for w in (windows([sizes[i] for i in rest], capacity) if full else ())]:
            place, own = 0, next(number)
            for i in members:
                order.append(i)
                sequence.append(own)
                offset.append(place)
                place += sizes[i]
        if not full:
            order += rest
            sequence += [None] * len(rest)
            offset += [None] * len(rest)
        out = rows.take(pa.array(order, pa.int64())).combine_chunks()
        for extra in (sequence, offset):
            out = out.append_column(f"_{out.num_columns}", pa.array(extra, pa.int64()))
        yield from out.rename_columns([*rows.column_names, "sequence_id", "offset"]).to_batches()

    base = GATHERED if gathered else 0
    number = itertools.count(base + TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, max(1, block - n))
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n >= block:
                yield from packed(pa.Table.from_batches(held), False)
                held, n = [], 0
    if held:
        yield from packed(pa.Table.from_batches(held), True)


def gather(first: DataFrame, capacity: int, block: int) -> DataFrame:
    """Placed pieces, those that their tasks left over included.

    The left ones, less than a block of each task, are dealt to tasks of some blocks each and packed there.
    """
    first = materialize(first)
    left = first.filter("sequence_id is null").drop("sequence_id", "offset")
    tasks = max(1, left.count() // (BLOCKS_GATHERED * block))
    at = left.columns.index("length")
    more = left.repartition(tasks).mapInArrow(lambda batches: placed(batches, at, capacity, block, True), first.schema)
    return first.filter("sequence_id is not null").unionByName(more)


def fields(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def pack(pieces: DataFrame, capacity: int, block: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; a sequence holds at most ``capacity`` ids.

    Needs a ``length`` from 1 to ``capacity`` in each row; all columns are kept,
    and ``sequence_id`` and ``offset`` replace columns of these names. Every task
    packs its own rows, block by block; only what does not fill a block is shuffled,
    and no group can be hot. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    at = pieces.columns.index("length")
    assert len(pieces.columns) == len(set(pieces.columns))
    first = pieces.mapInArrow(
        lambda batches: placed(batches, at, capacity, block), f"{fields(pieces)}, sequence_id long, offset long"
    )
    return gather(first, capacity, block)


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, max_tail: int = 512
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: the pieces of all documents, each id in one.

    A sequence's pieces follow one another without a gap from 0; ``ids`` are
    those of ``token_ids``. Null and repeated ids of documents are kept, a null
    text is an empty one (``end_id`` alone). Long texts are cut at every
    ``capacity`` ids. Columns other than ``doc_id`` and ``text`` are left out,
    whatever their names. A task tokenises, cuts and packs a block at a time, so
    no batch holds more than a block's ids; see ``pack`` for what does not fill a block.
    """
    shared, end = tokenizer_file(docs, path), end_bytes(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(batches, Tokens(shared.value), end, capacity, max_tail)
        yield from placed(pieces, PIECE.index("length"), capacity)

    texts = common.id_and_text(docs)
    first = texts.mapInArrow(
        run,
        f"{fields(texts.select('doc_id'))}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long",
    )
    return gather(first, capacity, BLOCK_PIECES)


def ids_crc32() -> Column:
    """The CRC-32 of a piece's ids."""
    return F.crc32("ids").alias("ids_crc32")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces, placed or not, with the CRC-32 of their ids in place of the ids."""
    return pieces.select(*[ids_crc32() if c == "ids" else c for c in pieces.columns])
