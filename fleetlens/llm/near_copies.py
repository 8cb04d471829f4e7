"""Near copies at a similarity of word shingles, by wide SimHash fingerprints.

``simhash`` links fingerprints of a few differing bits. At a Jaccard similarity of
0.8 about 15 of 100 bits differ, so that hardly any byte list of eight positions is
shared. Here a fingerprint has 24 positional bytes. The index lists it by pairs of
positions and the two bytes there; pairs of documents that meet in a list share at
least two positional bytes, the required tally. Eight bytes more name the
fingerprint and travel with the entry: a list's pairs are kept if their names differ
in few bits, then if all 256 bits do, and are verified by the exact Jaccard
similarity of their shingles.

The chance that a pair meets depends on its similarity alone: 0.93 at 0.8, 0.95 at
0.82, 0.99 at 0.9 (measured in the tests), and not on the table's size. Lists of two
bytes grow with the table; a caller may choose lists of three (``list_bytes``), with
chances of 0.79, 0.85, 0.98.

No list emits all its pairs. At first each member is compared with leaders only (in
a long list the first is the one nearest to the majority of bits), so that a list
gives fewer pairs than it has members. What these pairs join is a family; names
that were in a pair are listed once more, and families that have a near pair in a
list become one. Any two names that meet and are near are then of one family, and
all such pairs of a family are looked at where its texts lie, in blocks of bounded
size: a family's rows, not its pairs, are joined and shuffled. Only links that join
two components leave a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm import common
from fleetlens.llm.simhash import SEED, SHINGLES
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize, scratch_removed

WORDS, SIMILARITY = 5, 0.8
#: Positional bytes of a fingerprint, and those after them that name it.
BYTES, NAMED = 24, 8
#: Odd factors that make more hashes of a shingle's hash; fixed values.
MIXERS = (
    (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9),
    (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB),
    (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD),
)
#: A list's positions lie this far from its first one.
STEPS = {2: [(1,), (2,), (5,)], 3: [(1, 3), (1, 5), (2, 6), (2, 9), (3, 8), (3, 10), (4, 11), (1, 8), (5, 11)]}
#: Of more names the lists of one step are compared after those of another, the same pairs in smaller shuffles.
WIDE_ROWS = 1 << 26
#: A pair at the similarity differs in 10 bits of its names and 39 of all 256 on average; in more than
#: these once in 200 pairs. Names by chance differ in so few once in 7000.
NAME_BITS, ALL_BITS = 17, 54
#: In a list of more members the first leader is chosen.
LONG_LIST = 64
#: Cells of names that a task compares at a time.
CELLS = 1 << 20
#: A family of more members, or of more characters, is cut into blocks; a task compares two of them.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 23


def shingle_hashes(text: str, words_per_shingle: int = WORDS) -> np.ndarray:
    """A hash per word shingle, repeats included; of a text with fewer words one, of a text without words none."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < words_per_shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    parts = zip(*(itertools.islice(words, i, None) for i in range(words_per_shingle)))
    return np.fromiter((xxh64_intdigest(b" ".join(p), SEED) for p in parts), "<u8", len(words) - words_per_shingle + 1)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The positional bytes of a document's shingle hashes, then its name's; zeros if there are none."""
    ones = np.zeros(8 * (BYTES + NAMED), dtype=np.int64)
    for low in range(0, len(hashes), SHINGLES):
        some = hashes[low : low + SHINGLES]
        wide = [some]
        for first, second in MIXERS:
            mixed = some * np.uint64(first)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(second)
            wide.append(mixed ^ (mixed >> np.uint64(32)))
        bits = np.unpackbits(np.stack(wide, axis=1).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def fingerprints(rows: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """``row, name, bytes`` of ``rows(row, text)``; ``bytes`` are all of the fingerprint, ``name`` its last eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.portions(batches):
            made = np.stack([fingerprint(shingle_hashes(t, words_per_shingle)) for t in texts])
            names = np.ascontiguousarray(made[:, BYTES:]).view(np.int64).ravel()
            whole = pa.array([m.tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(names), whole], ["row", "name", "bytes"])

    return rows.select("row", "text").mapInArrow(run, "row long, name long, bytes binary")


def entries(prints: DataFrame, steps: Sequence[tuple[int, ...]]) -> DataFrame:
    """``list, name``: the index entries of ``prints(name, bytes)`` in the lists of some of ``STEPS`` of one size."""
    size = 1 + len(steps[0])
    places = np.array([[i, *((i + s) % BYTES for s in some)] for some in steps for i in range(BYTES)])
    number = np.arange(len(places), dtype=np.int64) << 8 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                held = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BYTES + NAMED)
                keys = np.tile(number, (len(held), 1))
                for i in range(size):
                    keys |= held[:, places[:, i]].astype(np.int64) << 8 * i
                names = np.repeat(part.column(0).to_numpy(), len(places))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(names)], ["list", "name"])

    return prints.select("name", "bytes").mapInArrow(run, "list long, name long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= NAME_BITS


def all_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of whole fingerprints, four numbers each, differ in few bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1) <= ALL_BITS


def meet(a: np.ndarray, b: np.ndarray, steps: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Which rows of whole fingerprints share a list of some of ``STEPS``."""
    same = a.view(np.uint8)[:, :BYTES] == b.view(np.uint8)[:, :BYTES]
    met = np.zeros(len(same), bool)
    for some in steps:
        met |= reduce(np.logical_and, (np.roll(same, -s, axis=1) for s in some), same).any(axis=1)
    return met


def middle(names: np.ndarray) -> int:
    """Which of a list's members is nearest to the majority of their bits."""
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(names), SHINGLES):
        some = names[low : low + SHINGLES]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(names), bitorder="little").view(np.uint64)[0]
    return int(np.argmin(np.bitwise_count(names ^ majority)))


def across(names: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list's members of different groups, all of them, in portions."""
    order = np.argsort(groups, kind="stable")
    names, groups = names[order], groups[order]
    # Rows of one group need only look at those of later groups: small groups look at the large ones.
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    by_size = np.argsort(sizes, kind="stable")
    names = np.concatenate([names[starts[i] : starts[i] + sizes[i]] for i in by_size])
    ends = np.repeat(np.cumsum(sizes[by_size]), sizes[by_size])
    low = 0
    while low < len(names) and ends[low] < len(names):
        high = min(len(names), low + max(1, CELLS // (len(names) - low)))
        found = near(names[low:high, None], names[None, low:])
        found &= np.arange(low, len(names))[None, :] >= ends[low:high, None]
        a, b = np.nonzero(found)
        yield names[low + a], names[low + b]
        low = high


def with_leaders(names: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members and leaders; ``run`` numbers the list of each member.

    A list's first member leads those near to it, the first of the rest leads next, until none is left.
    """
    while len(names):
        first = np.r_[True, run[1:] != run[:-1]]
        leaders = names[np.flatnonzero(first)[np.cumsum(first) - 1]]
        led = near(names, leaders) & ~first
        yield leaders[led], names[led]
        rest = ~(led | first)
        names, run = names[rest], run[rest]


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a task sorted by ``list``, the first one, in portions that end with a list."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(h) for h in zip(held, new)] if held else new
        last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if last:
            yield [h[:last] for h in held]
            held = [h[last:] for h in held]
    if held and len(held[0]):
        yield held


def pairs_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in pairs:
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def bounds(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    return starts, np.diff(np.r_[starts, len(lists)])


def first_pairs(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each list's members with leaders of the list."""
    lists, names = held[0], held[1].view(np.uint64).copy()
    starts, sizes = bounds(lists)
    for i in np.flatnonzero(sizes > LONG_LIST):
        at = starts[i] + middle(names[starts[i] : starts[i] + sizes[i]])
        names[[starts[i], at]] = names[[at, starts[i]]]
    paired = np.repeat(sizes > 1, sizes)
    yield from with_leaders(names[paired], lists[paired])


def unite(root: list[int], a: int, b: int) -> bool:
    """Whether two nodes were apart; they are together now."""
    ends = []
    for x in (a, b):
        while root[x] != x:
            root[x] = x = root[root[x]]
        ends.append(x)
    root[max(ends)] = min(ends)
    return ends[0] != ends[1]


def bridges(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join the families of each list's members, by whole fingerprints: fewer than the list has families."""
    lists, names, families, whole = held
    for start, size in zip(*bounds(lists)):
        part = slice(start, start + size)
        if size == 1 or (families[part] == families[start]).all():
            continue
        own, (_, group) = names[part].view(np.uint64), np.unique(families[part], return_inverse=True)
        prints = np.frombuffer(b"".join(whole[part]), np.uint64).reshape(-1, 4)
        order, root = np.argsort(own), list(range(group.max() + 1))
        for a, b in across(own, group):
            i, j = (order[np.searchsorted(own, x, sorter=order)] for x in (a, b))
            close = np.flatnonzero(all_near(prints[i], prints[j]))
            x, y = group[i[close]], group[j[close]]
            _, once = np.unique(np.minimum(x, y) * len(root) + np.maximum(x, y), return_index=True)
            joins = close[[k for k in once if unite(root, int(x[k]), int(y[k]))]]
            yield a[joins], b[joins]


def compared(listed: DataFrame, pairs: Callable) -> DataFrame:
    """``a, b``: distinct pairs of names that ``pairs`` finds in the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_lists(batches):
            yield from pairs_of(pairs(held))

    return listed.repartition("list").sortWithinPartitions("list", "name").mapInArrow(run, "a long, b long").distinct()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of shingles have the Jaccard similarity; two empty ones are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """``a, b`` of ``pairs(a, b)`` whose texts, of ``texts(key, text)``, are alike. Both are stored; a ``b`` is in one pair.

    The pairs are looked up where the texts of ``b`` lie, and only these go to those of ``a``, few and each in many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shingles = None, np.zeros(0, "<u8")  # pairs of one text of ``a`` follow each other where a join sorted them
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != key:
                    key, shingles = a, np.unique(shingle_hashes(batch.column(2)[i].as_py(), words_per_shingle))
                other = np.unique(shingle_hashes(batch.column(3)[i].as_py(), words_per_shingle))
                keep.append(alike(shingles, other, similarity))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    counts = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    of_a = of_rows(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), counts.select("a"), row="a")
    pairs = of_rows(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), pairs, row="b")
    pairs = lookup_join(pairs, of_a, "a", spread=["b"], counts=counts)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def of_rows(rows: DataFrame, wanted: DataFrame, how: str = "inner", row: str = "row") -> DataFrame:
    """``rows`` joined to ``wanted`` by a unique number, so that no key of either is hot."""
    return lookup_join(rows, wanted, row, how, spread=[row], counts=wanted.select(row, F.lit(1).alias("n")))


def of_names(rows: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """``rows``, few of a name, joined to ``wanted``, stored, which has a row per name at most."""
    return lookup_join(rows, wanted, "name", how, counts=wanted.select("name", F.lit(1).alias("n")))


def candidate_texts(pairs: DataFrame, firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, text`` of the names in ``pairs``: few of all, hence read from ``rows`` once by a semi-join."""
    names = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    wanted = materialize(names.join(firsts, "name").select("name", "row"))
    named = of_rows(rows.select("row", "text"), wanted)
    return materialize(named.select(F.col("name").alias("key"), "text"))


def alike_bits(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """``pairs(a, b)``, stored, whose whole fingerprints differ in at most ALL_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, 4) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(all_near(a, b)))

    for side in ("a", "b"):
        whole = prints.select(F.col("name").alias(side), F.col("bytes").alias(f"bytes_{side}"))
        pairs = lookup_join(pairs, whole, side, spread=["a", "b"])
    return materialize(pairs.select("a", "b", "bytes_a", "bytes_b").mapInArrow(run, "a long, b long"))


def united(parts: list[DataFrame]) -> DataFrame:
    """The distinct rows of tables that have each row once."""
    return parts[0] if len(parts) == 1 else materialize(reduce(DataFrame.unionByName, parts).distinct())


def one_each(pairs: DataFrame) -> DataFrame:
    """``a, b``: of the pairs of each name ``b`` the one with the name that is in most pairs, ``a``."""
    both = pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("name"), F.col("a").alias("other"))
    )
    counts = materialize(both.groupBy("other").agg(F.count(F.lit(1)).alias("n")))
    best = (
        lookup_join(both, counts, "other", spread=["name"], counts=counts)
        .groupBy("name")
        .agg(F.max_by("other", F.struct("n", "other")).alias("other"))
    )
    # Two names may have each other: then the smaller is ``a``.
    once = best.groupBy(F.least("name", "other").alias("low"), F.greatest("name", "other").alias("high")).agg(
        F.min("other").alias("a")
    )
    return materialize(once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")))


def block_pairs(members: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """``members(name, component, family, chars)``, stored, with ``block``, once for each ``low, high`` of two blocks to compare.

    Families of one component are left out. A large family is cut by a hash of
    the names, its largest component apart: blocks of that one are not compared
    with each other.
    """

    def room(n: Column, chars: Column) -> Column:
        return F.greatest(F.ceil(n / block_rows), F.ceil(chars / block_chars), F.lit(1)).cast("int")

    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    families = parts.groupBy("family").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("n"),
        F.sum("chars").alias("chars"),
        F.max(F.struct("n", "component", "chars")).alias("most"),
    )
    n, chars, cut = F.col("n"), F.col("chars"), room(F.col("n"), F.col("chars")) > 1
    cuts = families.filter("parts > 1").select(
        "family",
        F.when(cut, F.col("most.component")).alias("most"),
        F.when(cut, room(F.col("most.n"), F.col("most.chars"))).otherwise(0).alias("mosts"),
        F.when(cut, room(n - F.col("most.n"), chars - F.col("most.chars"))).otherwise(1).alias("rests"),
    )
    placed = lookup_join(members, materialize(cuts), "family", spread=["name"])
    in_most = F.coalesce(F.col("component") == F.col("most"), F.lit(False))
    mixed = F.xxhash64("name")
    block = F.when(in_most, F.pmod(mixed, F.greatest("mosts", F.lit(1)))).otherwise(F.col("mosts") + F.pmod(mixed, "rests"))
    others = F.sequence(F.when(in_most, F.col("mosts")).otherwise(0), F.col("mosts") + F.col("rests") - 1)
    placed = placed.withColumn("block", block.cast("int")).withColumn("other", F.explode(others))
    return placed.select(
        "name", "component", "family", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )


def with_texts(cells: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """``cells``, stored, with ``bytes`` of ``prints(name, bytes)`` and ``text`` of ``texts(name, text)``.

    Only texts of names that are in ``cells`` leave their place.
    """
    names = materialize(cells.select("name").distinct())
    wanted = materialize(of_names(prints, names))
    own = of_names(texts, wanted)
    return lookup_join(own, cells, "name", spread=["name"], counts=wanted.select("name", F.lit(1).alias("n")))


def new_links(
    prints: np.ndarray, components: np.ndarray, blocks: np.ndarray, texts: Sequence[str],
    words_per_shingle: int, similarity: float, steps: Sequence[tuple[int, ...]],
) -> Iterator[tuple[int, int]]:
    """Links that join components, of members ``i, j`` that meet, are near and have texts alike.

    Members of one block are compared with each other, those of two with those of the other block.
    """
    sets = [np.unique(shingle_hashes(t, words_per_shingle)) for t in texts]
    sizes = np.array([len(s) for s in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sets = np.split(number, np.cumsum(sizes)[:-1])
    held, names = np.zeros(number.max(initial=0) + 1, bool), prints[:, 3]
    _, group = np.unique(components, return_inverse=True)
    if blocks.min() == blocks.max():
        left = right = np.arange(len(texts))
    else:
        left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    high = 0
    while high < len(left):
        low, high = high, min(len(left), high + max(1, CELLS // len(right)))
        close = near(names[left[low:high], None], names[None, right])
        close &= group[left[low:high], None] != group[None, right]
        i, j = np.nonzero(close)
        i, j = left[low + i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        kept = all_near(prints[i], prints[j])
        i, j = i[kept], j[kept]
        kept = meet(prints[i], prints[j], steps)
        i, j = i[kept], j[kept]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for a, others in zip(i[starts], np.split(j, starts[1:])) if len(i) else ():
            others = others[group[others] != group[a]]
            if not len(others):
                continue
            held[sets[a]] = True
            ends = np.cumsum(sizes[others])
            found = np.r_[0, np.cumsum(held[np.concatenate([sets[b] for b in others])])]
            both = found[ends] - found[ends - sizes[others]]
            held[sets[a]] = False
            for b in others[both >= similarity * (sizes[a] + sizes[others] - both)]:
                if group[b] != group[a]:
                    yield int(a), int(b)
                    group[group == group[b]] = group[a]


def links_within(
    rows: DataFrame, words_per_shingle: int, similarity: float, steps: Sequence[tuple[int, ...]]
) -> DataFrame:
    """``a, b`` of ``rows``, those of ``block_pairs`` with ``bytes, text``: links between a family's components."""

    def run(table: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint64).reshape(-1, 4)
        names, components, blocks = (table[c].to_numpy() for c in ("name", "component", "block"))
        texts = table["text"].to_pylist()
        found = list(new_links(prints, components, blocks, texts, words_per_shingle, similarity, steps))
        a, b = (names[[f[side] for f in found]] if found else names[:0] for side in (0, 1))
        common.give_back()
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return rows.groupBy("family", "low", "high").applyInArrow(run, "a long, b long")


def linked_names(
    prints: DataFrame, rows: DataFrame, words_per_shingle: int, similarity: float, wide_rows: int, list_bytes: int = 2,
    block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``node, component`` of the names that verified links join; ``prints(name, row, bytes)`` has a row per name."""
    steps = STEPS[list_bytes]
    turns = [steps] if prints.count() <= wide_rows else [[s] for s in steps]
    firsts = prints.select("name", "row")
    pairs = alike_bits(united([materialize(compared(entries(prints, s), first_pairs)) for s in turns]), prints)
    families = materialize(common.components(pairs).withColumnsRenamed({"node": "name", "component": "family"}))
    texts = candidate_texts(pairs, firsts, rows)
    # A link or none for each name; the rest is for the families of several components.
    links = materialize(verified(one_each(pairs), texts, words_per_shingle, similarity))
    joined = materialize(common.components(links).withColumnRenamed("node", "name"))
    whole = materialize(of_names(families, prints.select("name", "bytes")))

    def joins(some: Sequence[tuple[int, ...]]) -> DataFrame:
        counts = families.select("name", F.lit(1).alias("n"))
        listed = lookup_join(entries(whole, some), whole, "name", spread=["list"], counts=counts)
        return materialize(compared(listed.select("list", "name", "family", "bytes"), bridges))

    more = united([joins(s) for s in turns])
    if not more.isEmpty():
        known = families.filter("name <> family").select(F.col("name").alias("a"), F.col("family").alias("b"))
        wider = common.components(known.unionByName(more)).withColumnsRenamed({"node": "name", "component": "family"})
        families = materialize(wider)
    named = texts.withColumnRenamed("key", "name")
    members = of_names(families, named.select("name", F.length("text").alias("chars")))
    members = of_names(members, joined, "left").withColumn("component", F.coalesce("component", "name"))
    cells = materialize(block_pairs(materialize(members), block_rows, block_chars))
    cells = with_texts(cells, whole.select("name", "bytes"), named)
    found = materialize(links_within(cells, words_per_shingle, similarity, steps))
    if found.isEmpty():
        return joined.withColumnRenamed("name", "node")
    return common.components(links.unionByName(found))


def group_rows(
    rows: DataFrame,
    words_per_shingle: int = WORDS,
    similarity: float = SIMILARITY,
    wide_rows: int = WIDE_ROWS,
    list_bytes: int = 2,
) -> DataFrame:
    """``row, root`` of ``rows(row, text)``, stored, ``row`` unique and ``text`` not null: rows of a group share the root."""
    prints = materialize(fingerprints(rows, words_per_shingle))
    names = materialize(
        prints.groupBy("name").agg(
            F.min("row").alias("first"), F.min_by("bytes", "row").alias("bytes"), F.count(F.lit(1)).alias("n")
        )
    )
    # Rows of one name are nearly always one set of shingles. One that isn't stays by itself.
    repeated = names.filter("n > 1").select("name", "first", "n")
    again = lookup_join(prints.select("row", "name"), materialize(repeated), "name", spread=["row"], counts=names.select("name", "n"))
    again = materialize(again.filter("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")))
    both = again.select(F.col("a").alias("row")).unionByName(again.select(F.col("b").alias("row"))).distinct()
    texts = of_rows(rows.select("row", "text"), materialize(both)).select(F.col("row").alias("key"), "text")
    texts = materialize(texts)
    same = materialize(verified(again, texts, words_per_shingle, similarity))

    firsts = names.select("name", F.col("first").alias("row"), "bytes")
    joined = linked_names(firsts, rows, words_per_shingle, similarity, wide_rows, list_bytes)
    roots = materialize(
        names.join(joined.withColumnRenamed("node", "name"), "name", "left").select(
            F.col("first").alias("row"), F.coalesce("component", "name").alias("component")
        )
    )
    least = roots.groupBy("component").agg(F.min("row").alias("root"))
    roots = materialize(roots.join(least, "component").select("row", "root"))
    others = lookup_join(same, roots.withColumnRenamed("row", "a"), "a", spread=["b"]).select(F.col("b").alias("row"), "root")
    apart = again.join(same, ["a", "b"], "left_anti").select(F.col("b").alias("row"), F.col("b").alias("root"))
    return materialize(roots.unionByName(others).unionByName(apart))


def drop_near_copies(
    docs: DataFrame,
    words_per_shingle: int = WORDS,
    similarity: float = SIMILARITY,
    wide_rows: int = WIDE_ROWS,
    list_bytes: int = 2,
    stored: bool = False,
) -> DataFrame:
    """``docs`` with one row of each group of near copies, of its smallest ``doc_id``, and the same columns.

    Texts are linked at a Jaccard similarity of their sets of word shingles (A-Z
    in lower case) of at least ``similarity``; groups are what links reach. A
    text of fewer words than a shingle is one shingle; texts without words, and
    null ones, are copies of each other. Of rows of one ``doc_id`` any stays;
    a null id comes last. An empty table stays empty. Columns other than
    ``doc_id`` and ``text`` are handed on. The result does not depend on
    ``wide_rows``. ``stored`` as in ``common.numbered``: the documents are then
    read again, not copied.
    """
    mark = "_kept_row"
    while mark in docs.columns:
        mark += "_"
    numbered = common.numbered(docs, mark, stored)
    rows = numbered.select(F.col(mark).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch_removed(docs.sparkSession) as keep:
        roots = group_rows(rows, words_per_shingle, similarity, wide_rows, list_bytes)
        # Few rows share their root with another: only these need their ids compared, only losers are looked up.
        shared = materialize(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        members = materialize(lookup_join(roots, shared, "root", spread=["row"], counts=shared).select("row", "root"))
        ids = of_rows(numbered.select(F.col(mark).alias("row"), "doc_id"), members)
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        kept = materialize(ids.groupBy("root").agg(F.min_by("row", order).alias("row")))
        others = members.join(kept, ["root", "row"], "left_anti")
        lost = keep(others.select(F.col("row").alias(mark), F.lit(True).alias(f"{mark}lost")))
    marked = of_rows(numbered, lost, "left", mark)
    return marked.filter(F.col(f"{mark}lost").isNull()).select(*docs.columns)
