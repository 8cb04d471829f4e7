"""Near-duplicates by SimHash, over an inverted index of the fingerprints' bytes.

A fingerprint has eight positional bytes, and two differing bits touch at most two
of them: linked fingerprints share at least six. The index therefore lists
fingerprints by each choice of six positions and the bytes there, and a pair's tally
of shared bytes reaches six exactly if the two meet in a list. (Lists by single
bytes would hold 1/256 of all fingerprints each, and their pairs would grow with the
square of the input.) Within a list only two bytes are open, so it has at most
65,536 members whatever the data. Pairs are tallied once, in the first list that
they share, and verified by their differing bits; groups of linked fingerprints are
distributed connected components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm import common
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

SEED = 42
#: Shingles whose bits are added up at a time.
SHINGLES = 65_536
#: Up to this many members a list's pairs are tallied one by one, beyond it by the open 16 bits.
SMALL_LIST = 64
POSITIONS = 8


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, zero if it has no word."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - words_per_shingle + 1
        shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(words_per_shingle))))
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, n, SHINGLES):
        some = itertools.islice(shingles, SHINGLES)
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in some), "<u8", min(SHINGLES, n - low))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a signed long) of every whole text; null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.portions(batches):
            made = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(made)], ["doc_id", "fingerprint"])

    texts = common.id_and_text(docs)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fingerprint long")


class Index:
    """Choices of byte positions that any two fingerprints within ``max_bits`` share one of."""

    def __init__(self, max_bits: int):
        if not 1 <= max_bits <= 2:
            raise ValueError("max_bits must be 1 or 2: a list's open bytes are enumerated")
        self.max_bits, self.shared = max_bits, POSITIONS - max_bits
        self.choices = list(itertools.combinations(range(POSITIONS), self.shared))
        self.masks = [sum(0xFF << 8 * p for p in choice) for choice in self.choices]
        # By the set of equal bytes: the first choice within it.
        self.first = np.full(256, -1)
        for equal in range(256):
            for i, choice in enumerate(self.choices):
                if all(equal >> p & 1 for p in choice):
                    self.first[equal] = i
                    break

    def entries(self, fp: Column) -> Column:
        """The index entries of a fingerprint: choice and bytes."""
        signed = [m - 2**64 if m >= 2**63 else m for m in self.masks]
        return F.array(
            *[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)]
        )

    def small(self, choice: np.ndarray, fp: np.ndarray, run: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links within lists of at most SMALL_LIST members; ``run`` numbers the list of each member."""
        left, right = [], []
        at = np.flatnonzero((size > 1) & (size <= SMALL_LIST))
        for step in range(1, int(size[at].max(initial=1))):
            at = at[at + step < len(fp)]
            at = at[run[at] == run[at + step]]
            a, b = fp[at], fp[at + step]
            differ = (a ^ b).view(np.uint8).reshape(-1, POSITIONS) if len(at) else np.zeros((0, POSITIONS), np.uint8)
            equal = differ == 0
            tally = equal.sum(axis=1)
            met = self.first[np.packbits(equal, axis=1, bitorder="little").ravel()] == choice[at]
            near = (tally >= self.shared) & met & (np.bitwise_count(a ^ b) <= self.max_bits)
            left.append(a[near])
            right.append(b[near])
        return np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])

    def large(self, choice: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A list of more members: each is linked to the smallest it reaches within the list.

        The members differ in the open bytes only, so members are looked up by
        their open bits with up to ``max_bits`` of them flipped.
        """
        open_bits = [8 * p + i for p in range(POSITIONS) if p not in self.choices[choice] for i in range(8)]
        place = np.zeros(len(fp), dtype=np.int64)
        for i, bit in enumerate(open_bits):
            place |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
        nobody = 1 << len(open_bits)
        reach = np.full(nobody, nobody)
        reach[place] = place
        flips = [sum(1 << i for i in c) for n in range(1, self.max_bits + 1) for c in itertools.combinations(range(len(open_bits)), n)]
        while True:
            before = reach[place]
            now = before.copy()
            for flip in flips:
                np.minimum(now, reach[place ^ flip], out=now)
            now = np.minimum(now, reach[now])
            if (now == before).all():
                break
            reach[place] = now
        member = np.zeros(nobody, dtype=np.uint64)
        member[place] = fp
        root = member[before]
        return fp[root != fp], root[root != fp]


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``a, b``: links that join all of ``prints(fingerprint)``, distinct, within ``max_bits`` of each other."""
    index = Index(max_bits)
    entries = prints.select("fingerprint", F.explode(index.entries(F.col("fingerprint"))).alias("e")).select(
        "e.choice", "e.bytes", "fingerprint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(i).to_numpy() for i in range(3)]
                held = [np.concatenate([h, n.view(h.dtype) if n.dtype.itemsize == 8 else n.astype(h.dtype)]) for h, n in zip(held, new)]
            choice, key, fp = held
            if not len(fp):
                continue
            starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
            if batch is not None:  # the last list may go on
                held = [h[starts[-1] :] for h in held]
                choice, fp = choice[: starts[-1]], fp[: starts[-1]]
                starts = starts[:-1]
            size = np.diff(np.r_[starts, len(fp)])
            number = np.repeat(np.arange(len(size)), size)
            found = [index.small(choice, fp, number, np.repeat(size, size))]
            for i in np.flatnonzero(size > SMALL_LIST):
                found.append(index.large(int(choice[starts[i]]), fp[starts[i] : starts[i] + size[i]]))
            a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return (
        entries.repartition("choice", "bytes")
        .sortWithinPartitions("choice", "bytes")
        .mapInArrow(run, "a long, b long")
    )


def group_rows(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """``rows(doc_id, fingerprint, ...)``, stored, with ``root`` and ``component_id``.

    ``root`` is one fingerprint per group, ``component_id`` the group's smallest
    ``doc_id``; nulls are passed over unless all ids of a group are null.
    """
    prints = materialize(
        rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    )
    linked = common.components(links(prints.select("fingerprint"), max_bits)).withColumnsRenamed(
        {"node": "fingerprint", "component": "root"}
    )
    # Only linked fingerprints can have another's component.
    named = linked.join(prints, "fingerprint")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fingerprint", "root", "component_id")
    alone = prints.join(linked, "fingerprint", "left_anti").select(
        "fingerprint", F.col("fingerprint").alias("root"), F.col("least").alias("component_id")
    )
    lookup = materialize(named.unionByName(alone))
    return lookup_join(rows, lookup, "fingerprint", spread=["doc_id"], counts=prints.select("fingerprint", "n"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    A text of fewer words than a shingle has one shingle, all its words; a text
    without words (or null) has fingerprint zero and is linked like any other.
    ``fingerprint`` is 16 lowercase hex digits. Repeated rows share their
    fingerprint, hence their component. An empty table gives an empty one;
    columns other than ``doc_id`` and ``text`` are not looked at.
    """
    rows = materialize(fingerprints(docs, words_per_shingle))
    return group_rows(rows, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``, of its smallest ``doc_id``, and the same columns."""
    mark = "_kept_row"
    while mark in docs.columns:
        mark += "_"
    numbered = materialize(docs.withColumn(mark, F.monotonically_increasing_id()))
    prints = fingerprints(numbered.select(F.struct(mark, "doc_id").alias("doc_id"), "text"), words_per_shingle)
    rows = materialize(prints.select(F.col(f"doc_id.{mark}").alias("row"), F.col("doc_id.doc_id").alias("doc_id"), "fingerprint"))
    kept = (
        group_rows(rows, max_bits)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("row").alias(mark))
    )
    # As many rows as there are groups: a table that grows with the documents is not for broadcasting.
    return numbered.join(materialize(kept.select(mark)).hint("merge"), mark, "left_semi").drop(mark)
