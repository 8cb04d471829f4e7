"""Token counts by a BPE with word ends, merged for many words at a time.

The distinct pre-tokens of a portion lie end to end in one array of symbols. In
each round every sequence applies its pair of lowest rank, at all places at once;
sequences without a pair leave. What is left of a sequence are its tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm import common

#: Longer pre-tokens (a text without spaces is one) are merged on their own.
LONG_BYTES = 1024

_NO_PAIR = np.iinfo(np.int64).max
#: Characters at which Python splits a text although they aren't white space to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(others.get(b, b)) for b in range(256)]


class Merges:
    """Symbols and ranked pairs of a tokenizer file whose model is a BPE with word ends.

    The text is composed (NFC) and lower-cased; the file's own split pattern
    finds the pre-tokens; added tokens are found in the raw text before that.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, kinds = file["model"], [n["type"] for n in file["normalizer"]["normalizers"]]
        split, level = file["pre_tokenizer"]["pretokenizers"]
        if (
            kinds != ["NFC", "Replace", "Lowercase"]
            or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True)
            or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False)
            or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in file["added_tokens"])
        ):
            raise ValueError(f"{path}: a tokenizer of another kind")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.name = path
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pattern = split["pattern"]["Regex"]
        self.added = [a["content"] for a in file["added_tokens"]]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], _NO_PAIR)

    def long_count(self, piece: bytes) -> int:
        """Number of tokens of a long pre-token: rank by rank, each at all its places at once.

        Places are kept by rank, symbols are linked, and after a rank only the pairs beside changed places are
        looked up. So the work follows the merges, not the length times the number of ranks.
        """
        n = len(piece)
        symbols = self.inner[np.frombuffer(piece, dtype=np.uint8)]
        symbols[-1] = self.last[piece[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        alive = np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            """Note the ranks of the pairs that begin at some places."""
            at = at[after[at] < n]
            found = self.pair_ranks(symbols[at], symbols[after[at]])
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else []
            for a, b in zip(starts, [*starts[1:], len(found)]):
                rank = int(found[a])
                if rank != _NO_PAIR:
                    if rank not in places:
                        heappush(ranks, rank)
                    places.setdefault(rank, []).append(at[a:b])

        put(np.arange(n))
        while ranks:
            rank = heappop(ranks)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[alive[at]]
            at = at[after[at] < n]
            hits = at[self.pair_ranks(symbols[at], symbols[after[at]]) == rank]
            if len(hits) == 0:
                continue
            # Of hits that overlap ("aaa"), every second one from the left.
            first = np.r_[True, after[hits[:-1]] != hits[1:]]
            run = np.cumsum(first) - 1
            hits = hits[(np.arange(len(hits)) - np.flatnonzero(first)[run]) % 2 == 0]
            gone = after[hits]
            symbols[hits], alive[gone] = self.made[rank], False
            after[hits] = after[gone]
            inner = hits[after[hits] < n]
            before[after[inner]] = inner
            left = before[hits]
            put(np.union1d(hits, left[left >= 0]))
        return int(alive.sum())

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty pre-token."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG_BYTES]
        if not long:
            return self.short_counts(pieces)
        out = np.zeros(len(pieces), dtype=np.int64)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG_BYTES]
        out[short] = self.short_counts([pieces[i] for i in short])
        out[long] = [self.long_count(pieces[i]) for i in long]
        return out

    def short_counts(self, pieces: list[bytes]) -> np.ndarray:
        """The same for pre-tokens side by side, in rounds over all of their symbols."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), dtype=np.int64)
        symbols = self.inner[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        if len(pieces):
            symbols[ends - 1] = self.last[np.frombuffer(b"".join(p[-1:] for p in pieces), dtype=np.uint8)]
        owner = np.arange(len(pieces))
        while len(lengths):
            starts, where = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
            rank = np.full(len(symbols), _NO_PAIR)
            inside = where[:-1] == where[1:]
            rank[:-1][inside] = self.pair_ranks(symbols[:-1][inside], symbols[1:][inside])
            least = np.minimum.reduceat(rank, starts)
            out[owner] = lengths
            hits = np.flatnonzero((rank == least[where]) & (rank != _NO_PAIR))
            if len(hits) == 0:
                break
            # Of hits that overlap ("aaa"), every second one from the left.
            first = np.r_[True, np.diff(hits) != 1]
            run = np.cumsum(first) - 1
            hits = hits[(hits - hits[first][run]) % 2 == 0]
            symbols[hits] = self.made[rank[hits]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[hits + 1] = False
            stays &= (least != _NO_PAIR)[where]
            symbols = symbols[stays]
            lengths = np.bincount(where[stays], minlength=len(lengths))
            left = lengths > 0
            lengths, owner = lengths[left], owner[left]
        return out


class Counter:
    """Counts of whole texts; a worker keeps the counts of the words that it has met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.find = regex.compile(merges.pattern).findall
        self.blank = regex.compile(r"\s+")
        self.special = re.compile("|".join(map(re.escape, merges.added)) or "(?!)")
        self.words: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The text's runs without white space; no pre-token reaches beyond one."""
        return [w for w in self.blank.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def pieces(self, word: str) -> list[bytes]:
        # Lower-casing goes letter by letter: no final sigma.
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return [p.encode() for p in self.find(word)]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.words) > common.MEMO_ENTRIES:
            self.words.clear()
        known, added, words = self.words, [], []
        for text in texts:
            parts = self.special.split(text)
            added.append(len(parts) - 1)
            words.append(self.split(text) if len(parts) == 1 else [w for p in parts for w in self.split(p)])
        new = list(set().union(*words).difference(known)) if words else []
        made = list(map(self.pieces, new))
        distinct = list({p for pieces in made for p in pieces})
        count = dict(zip(distinct, self.merges.counts(distinct).tolist()))
        known.update((w, sum(map(count.__getitem__, pieces))) for w, pieces in zip(new, made))
        counts = [n + sum(map(known.__getitem__, ws)) for n, ws in zip(added, words)]
        for w in new:
            if len(w) > common.MEMO_CHARS:
                del known[w]
        return counts


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each whole text, by the tokenizer file at ``path`` on the driver.

    Strings of added tokens count as one token each, as by the file's default;
    none is added at the ends. A row per row: repeated and null ids are kept, a
    null text is an empty one and has no tokens. Other columns are left out,
    whatever their names. The file, which does not grow with the data, is
    broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        counter = _counters.get(merges.name) or _counters.setdefault(merges.name, Counter(merges))
        for ids, texts in common.portions(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    texts = common.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Counts with ``over_limit``: whether a document has more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
