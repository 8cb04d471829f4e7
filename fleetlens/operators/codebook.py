"""Corpus symbol histogram, optimal prefix codebook, encoding and size report.

A codebook is a table ``symbol, freq, code, bits``. It has at most one row per
Unicode code point (1,114,112), which bounds what is collected or broadcast.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_CODEBOOK = "symbol string, freq bigint, code string, bits int"
_ENCODED = "data binary, pad int, blocks array<int>"
_TABLE_BITS, _WORD_BITS = 16, 32
_POINT_BITS, _POINT = 21, (1 << 21) - 1

#: Symbols of a block, whose bits are stored; of a portion that is encoded at once; blocks that are decoded side by side.
BLOCK, PORTION, LANES = 256, 65_536, 8_192
#: Rows that an encoder or a decoder hands on at a time.
ROWS = 256


def _symbols(texts: pa.Array) -> Iterator[str]:
    """All that the texts hold, in portions of about ``PORTION`` symbols."""
    some, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        for low in range(0, len(text), PORTION):
            some.append(text[low : low + PORTION])
            size += len(some[-1])
            if size >= PORTION:
                yield "".join(some)
                some, size = [], 0
    if some:
        yield "".join(some)


def symbol_histogram(df: DataFrame, col: str) -> DataFrame:
    """``symbol, freq`` over all texts, per code point.

    A task counts portions of ``PORTION`` symbols, each with one ``bincount``, into one array over all code points: what
    leaves it is a row per symbol, and what it holds besides an Arrow batch does not grow with the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            for text in _symbols(batch.column(0)):
                some = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
                freq[: len(some)] += some
        seen = np.flatnonzero(freq)
        symbols = pa.array([chr(c) for c in seen], pa.string())
        yield pa.RecordBatch.from_arrays([symbols, pa.array(freq[seen], pa.int64())], ["symbol", "freq"])

    counts = df.select(col).mapInArrow(count, "symbol string, freq bigint")
    return counts.groupBy("symbol").agg(F.sum("freq").alias("freq"))


def _code_lengths(freqs: list[int]) -> list[int]:
    """Optimal code length per symbol; ties go to the earlier symbol or merge."""
    if len(freqs) == 1:
        return [1]
    heap = [(freq, i) for i, freq in enumerate(freqs)]
    heapq.heapify(heap)
    above = [0] * (2 * len(freqs) - 1)
    for node in range(len(freqs), len(above)):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        above[left] = above[right] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * len(above)
    for node in range(len(above) - 2, -1, -1):
        depth[node] = depth[above[node]] + 1
    return depth[: len(freqs)]


def _assign_codes(hist: pd.DataFrame) -> pd.DataFrame:
    """Codes of each length in symbol order, so lengths alone determine them."""
    hist = hist.sort_values("symbol").reset_index(drop=True)
    hist["bits"] = _code_lengths(hist["freq"].tolist())
    hist = hist.sort_values(["bits", "symbol"]).reset_index(drop=True)
    codes, code, length = [], 0, int(hist["bits"].iloc[0])
    for bits in hist["bits"]:
        code <<= bits - length
        length = bits
        codes.append(format(code, f"0{bits}b"))
        code += 1
    hist["code"] = codes
    return hist[["symbol", "freq", "code", "bits"]]


def codebook(histogram: DataFrame) -> DataFrame:
    """Prefix codes of least total length; a single symbol gets the code ``0``."""
    return histogram.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_assign_codes, _CODEBOOK)


def _packed(codes: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, int]:
    """Codes (of at most 32 bits) one after the other from bit ``begin`` on, in 64-bit words, and where they end."""
    last = np.cumsum(sizes, dtype=np.int64)
    last += begin - 1
    end = int(last[-1]) + 1
    words = np.zeros(end // 64 + 1, np.uint64)
    word, inside = last >> 6, (last & 63).astype(np.uint8)
    # No two codes share a bit, so sums of a word's codes put them next to each other.
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    words[word[first]] += np.add.reduceat(codes << (63 - inside), first)
    spill = first[inside[first] + 1 < sizes[first]]  # a word's first code may begin in the word before
    words[word[spill] - 1] += codes[spill] >> (inside[spill] + np.uint8(1))
    return words, end


def _measured(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a portion and the lengths of their codes."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = sizes.take(points, mode="clip")
    if not size.all() or int(points.max()) >= len(sizes):
        raise ValueError(f"no code for {next(c for c in text if ord(c) >= len(sizes) or not sizes[ord(c)])!r}")
    return points, size


def _encode_one(text: str, codes: np.ndarray, sizes: np.ndarray, long: dict[int, int]) -> tuple[bytes, int, list[int]]:
    """A text's codes after ``pad`` zero bits, and the bits of each block; in portions that carry their last bits on."""
    bits: list[np.ndarray] = []
    points = size = None
    for low in range(0, len(text), PORTION):
        points, size = _measured(text[low : low + PORTION], sizes)
        bits.append(np.add.reduceat(size, np.arange(0, len(size), BLOCK), dtype=np.int64))
    blocks = np.concatenate(bits) if bits else np.zeros(0, np.int64)
    pad = -int(blocks.sum()) % 8
    out, carry, at = bytearray(), 0, pad  # `at` bits of the next word are there already
    for low in range(0, len(text), PORTION):
        if len(text) > PORTION:
            points, size = _measured(text[low : low + PORTION], sizes)
        if long and (size > _WORD_BITS).any():
            value = carry >> (64 - at) if at else 0
            for point, n in zip(points.tolist(), size.tolist()):
                value, at = value << n | (long[point] if n > _WORD_BITS else int(codes[point])), at + n
            whole = at // 64 * 8
            value <<= -at % 64
            data = value.to_bytes(-(-at // 64) * 8, "big")
            out += data[:whole]
            carry, at = int.from_bytes(data[whole:], "big"), at % 64
            continue
        words, end = _packed(codes.take(points), size, at)
        words[0] += np.uint64(carry)
        whole, at = end // 64, end % 64
        out += words[:whole].astype(">u8").tobytes()
        carry = int(words[whole]) if at else 0
    out += carry.to_bytes(8, "big")[: -(-at // 8)]
    return bytes(out), pad, blocks.tolist()


def _encoded(made: list[tuple]) -> pa.StructArray:
    kinds = {"data": pa.binary(), "pad": pa.int32(), "blocks": pa.list_(pa.int32())}
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds.values())], list(kinds))


def encode_corpus(df: DataFrame, book: DataFrame, col: str) -> DataFrame:
    """Add ``data``, ``pad`` and ``blocks``: the text's codes in whole bytes after ``pad`` zero bits.

    ``blocks`` has the number of bits of every ``BLOCK`` symbols, so that they can be decoded side by side. A task holds
    a text, its code and about 64 bytes for each of ``PORTION`` symbols, besides an Arrow batch.
    """
    shared = df.sparkSession.sparkContext.broadcast([(ord(r.symbol), int(r.code, 2), r.bits) for r in book.collect()])

    @F.arrow_udf(_ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last = max((point for point, _, _ in shared.value), default=-1)
        codes, sizes, long = np.zeros(last + 1, np.uint64), np.zeros(last + 1, np.uint8), {}
        for point, code, size in shared.value:
            sizes[point] = size
            if size <= _WORD_BITS:
                codes[point] = code
            else:
                long[point] = code
        for texts in batches:
            made, held = [], 0
            for value in texts:
                text = value.as_py()
                made.append((None, None, None) if text is None else _encode_one(text, codes, sizes, long))
                held += len(text or "")
                if held >= PORTION or len(made) == ROWS:
                    yield _encoded(made)
                    made, held = [], 0
            if made:
                yield _encoded(made)

    return df.withColumn("_encoded", encode(F.col(col))).select(*df.columns, "_encoded.*")


def _threes(data: bytes) -> np.ndarray:
    """Every byte with the two after it, so that one look-up shows all bits of a table's entry."""
    one = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    return one[:-2] << 16 | one[1:-1] << 8 | one[2:]


class _Decoder:
    """Decodes blocks side by side: a step looks up one symbol of each.

    A table tells symbol and length of the code that starts with any given ``_TABLE_BITS`` bits;
    the rare longer codes are read bit by bit.
    """

    def __init__(self, codes: list[tuple[str, int]]) -> None:
        self.table = np.zeros(1 << _TABLE_BITS, np.uint32)  # length, then code point
        self.long: dict[str, int] = {}
        for code, point in codes:
            if len(code) > _TABLE_BITS:
                self.long[code] = point
                continue
            first = int(code, 2) << (_TABLE_BITS - len(code))
            span = slice(first, first + (1 << (_TABLE_BITS - len(code))))
            self.table[span] = len(code) << _POINT_BITS | point

    def rare(self, data: np.ndarray, at: int, end: int) -> tuple[int, int]:
        """Symbol and length of a code longer than the table's."""
        size = _TABLE_BITS
        while at + size < end:
            size += 1
            some = (data[at // 8 : (at + size) // 8 + 1] >> 16).astype(np.uint8)
            bits = np.unpackbits(some)[at % 8 : at % 8 + size]
            if (code := "".join(map(str, bits))) in self.long:
                return self.long[code], size
        raise ValueError("the data does not end with a code")

    def lanes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each lane of bits, a column each, and how many there are; ``data`` as from ``_threes``."""
        found, counts = np.zeros((most, len(starts)), np.uint32), np.zeros(len(starts), np.int64)
        live = np.flatnonzero(starts < ends)
        at, end = starts[live], ends[live]
        for step in range(most):
            if not len(live):
                break
            at_byte = data.take(at >> 3)
            entry = self.table.take((at_byte >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF)
            size = (entry >> _POINT_BITS).astype(np.int64)
            if not size.all():
                for i in np.flatnonzero(size == 0):
                    entry[i], size[i] = self.rare(data, int(at[i]), int(end[i]))
            found[step, live] = entry & _POINT
            at = at + size
            going = at < end
            if not going.all():
                if (at > end).any():
                    raise ValueError("the data does not end with a code")
                counts[live[~going]] = step + 1
                live, at, end = live[going], at[going], end[going]
        if len(live):
            raise ValueError("the data does not end with a code")
        return found, counts

    def texts(self, rows: list[tuple[bytes, int, list[int]]]) -> Iterator[str]:
        """Texts of some rows; what is held is bounded by their data and ``LANES`` blocks."""
        data = _threes(b"".join(r[0] for r in rows))
        offsets = np.cumsum([0, *(8 * len(r[0]) for r in rows)])
        ends = [o + pad + np.cumsum(np.array(b, np.int64)) for o, (_, pad, b) in zip(offsets, rows)]
        starts = [np.concatenate([[o + r[1]], e[:-1]]) if len(e) else e for o, r, e in zip(offsets, rows, ends)]
        owner = np.repeat(np.arange(len(rows)), [len(e) for e in ends])
        first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        made: list[list[str]] = [[] for _ in rows]
        for low in range(0, len(first), LANES):
            some = slice(low, low + LANES)
            found, counts = self.lanes(data, first[some], last[some], BLOCK)
            flat = found.T[np.arange(BLOCK) < counts[:, None]]
            cuts = np.cumsum(np.bincount(owner[some], counts, len(rows)).astype(np.int64))
            for i in np.unique(owner[some]).tolist():
                mine = flat[cuts[i - 1] if i else 0 : cuts[i]]
                made[i].append(mine.astype("<u4").tobytes().decode("utf-32-le"))
        return ("".join(m) for m in made)


def _portions(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows of up to about ``LANES`` blocks together, or a single longer one."""
    some, size = [], 0
    for row in rows:
        if some and size + len(row[2]) > LANES:
            yield some
            some, size = [], 0
        some.append(row)
        size += len(row[2])
    if some:
        yield some


def _whole(data: bytes, pad: int, decoder: _Decoder) -> list[int]:
    """Bits of the blocks of a text that came without them: its codes are followed one by one."""
    bits, at, start, blocks, n = _threes(data), pad, pad, [], 0
    while at < 8 * len(data):
        entry = int(decoder.table[int(bits[at >> 3]) >> (8 - (at & 7)) & 0xFFFF])
        size = entry >> _POINT_BITS or decoder.rare(bits, at, 8 * len(data))[1]
        at, n = at + size, n + 1
        if n % BLOCK == 0:
            blocks.append(at - start)
            start = at
    if at > start:
        blocks.append(at - start)
    return blocks


def decode_corpus(df: DataFrame, book: DataFrame, name: str = "decoded") -> DataFrame:
    """Add the text that ``data``, ``pad`` and ``blocks`` encode.

    All blocks of a text, or of several, are decoded side by side. Without ``blocks`` a text's codes are followed first,
    one by one, to find them.
    """
    shared = df.sparkSession.sparkContext.broadcast([(r.code, ord(r.symbol)) for r in book.collect()])

    @F.arrow_udf("string")
    def decode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        decoder = _Decoder(shared.value)
        for batch in batches:
            for low in range(0, len(batch[0]), ROWS):
                some = [*zip(*(column.slice(low, ROWS).to_pylist() for column in batch))]
                rows = [(d, p, _whole(d, p, decoder) if b is None else b) for d, p, b in some if d is not None]
                texts = (t for part in _portions(rows) for t in decoder.texts(part))
                yield pa.array([None if d is None else next(texts) for d, _, _ in some], pa.string())

    blocks = F.col("blocks") if "blocks" in df.columns else F.lit(None).cast("array<int>")
    return df.withColumn(name, decode(F.col("data"), F.col("pad"), blocks))


def size_report(histogram: DataFrame, book: DataFrame) -> DataFrame:
    """One row: symbols in the corpus before encoding, bits and whole bytes after."""
    bits = F.sum(F.col("freq") * F.col("bits"))
    return (
        histogram.join(book.select("symbol", "bits"), "symbol")
        .agg(F.count(F.lit(1)).alias("symbols"), F.sum("freq").alias("raw_length"), bits.alias("encoded_bits"))
        .withColumn("encoded_length", F.ceil(F.col("encoded_bits") / 8))
    )
