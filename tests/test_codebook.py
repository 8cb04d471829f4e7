import heapq
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from fleetlens.operators import codebook

TEXT = "aaabbcdefaaabbcdefaaabbcdef"


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def books(spark, *texts):
    return codebook.codebook(codebook.symbol_histogram(corpus(spark, *texts), "text"))


def least_bits(freqs):
    heap = list(freqs)
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def assert_prefix_code(rows):
    codes = sorted(r.code for r in rows)
    assert all(not b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert all(len(r.code) == r.bits for r in rows)
    if len(rows) > 1:
        assert sum(2.0**-r.bits for r in rows) == 1.0


def test_known_text(spark, rows):
    histogram = codebook.symbol_histogram(corpus(spark, TEXT), "text")
    assert rows(histogram) == [("a", 9), ("b", 6), ("c", 3), ("d", 3), ("e", 3), ("f", 3)]
    book = codebook.codebook(histogram)
    assert_prefix_code(book.collect())
    assert rows(codebook.size_report(histogram, book)) == [(6, 27, 66, 9)]


def test_edges(spark, rows):
    assert rows(books(spark, "aaaa")) == [("a", 4, "0", 1)]
    assert books(spark, "", None).count() == 0
    assert codebook.symbol_histogram(corpus(spark, "é😀", "😀"), "text").count() == 2


def test_round_trip(spark):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(32, 400)] + ["😀", "\n", "0", "1"]
    weights = [1.6**-i + 1e-6 for i in range(len(alphabet))]
    texts = ["".join(rng.choices(alphabet, weights, k=rng.randrange(0, 3000))) for _ in range(60)] + ["", None, "".join(alphabet)]
    df = corpus(spark, *texts)
    book = codebook.codebook(codebook.symbol_histogram(df, "text")).cache()
    assert_prefix_code(book.collect())
    packed = codebook.encode_corpus(df, book, "text")
    back = codebook.decode_corpus(packed, book).orderBy("id").collect()
    assert [r.decoded for r in back] == texts
    total = "".join(t or "" for t in texts)
    bits = sum(8 * len(r.data) - r.pad for r in back if r.data is not None)
    assert bits == least_bits(Counter(total).values())
    assert all(0 <= r.pad < 8 for r in back if r.pad is not None)


def test_unknown_symbols_are_an_error(spark):
    book = books(spark, "abc")
    with pytest.raises(Exception, match="no code for '1'"):
        codebook.encode_corpus(corpus(spark, "ab1"), book, "text").collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10**12), min_size=1, max_size=60))
def test_lengths_are_optimal(freqs):
    lengths = codebook._code_lengths(freqs)
    assert sum(f * n for f, n in zip(freqs, lengths)) == least_bits(freqs)


def coder(freqs):
    """Codes as tasks hold them, and a decoder."""
    import numpy as np
    import pandas as pd

    book = codebook._assign_codes(pd.DataFrame({"symbol": list(freqs), "freq": list(freqs.values())}))
    codes, sizes, long = np.zeros(0x110000, np.uint64), np.zeros(0x110000, np.uint8), {}
    for symbol, code, bits in zip(book["symbol"], book["code"], book["bits"]):
        sizes[ord(symbol)] = bits
        if bits <= codebook._WORD_BITS:
            codes[ord(symbol)] = int(code, 2)
        else:
            long[ord(symbol)] = int(code, 2)
    spelled = dict(zip(book["symbol"], book["code"]))
    return lambda t: codebook._encode_one(t, codes, sizes, long), codebook._Decoder([(c, ord(s)) for s, c in spelled.items()]), spelled


@pytest.mark.parametrize("symbols", [2, 12, 60])
def test_blocks_and_portions(monkeypatch, symbols):
    """Fibonacci frequencies give codes of up to ``symbols - 1`` bits, beyond a word and beyond the table."""
    fib = [1, 1]
    while len(fib) < symbols:
        fib.append(fib[-1] + fib[-2])
    encode, decoder, spelled = coder({chr(97 + i): f for i, f in enumerate(fib)})
    rng = random.Random(symbols)
    for portion in (256, 1024, 65_536):
        monkeypatch.setattr(codebook, "PORTION", portion)
        for n in (0, 1, 2, 255, 256, 257, 512, 3000):
            text = "".join(rng.choices(list(spelled), [1 + i % 3 * 20 for i in range(symbols)], k=n))
            data, pad, blocks = encode(text)
            bits = "".join(spelled[c] for c in text)
            assert len(blocks) == -(-n // 256) and sum(blocks) == len(bits) and pad == -len(bits) % 8
            assert data == int("0" * pad + bits or "0", 2).to_bytes((pad + len(bits)) // 8, "big")
            for given in (blocks, codebook._whole(data, pad, decoder)):
                assert list(decoder.texts([(b"", 0, []), (data, pad, given), (data, pad, given)])) == ["", text, text]


def test_a_long_text_in_bounded_memory():
    """Beside the text and its code, coding holds a portion, and decoding its lanes."""
    import time
    import tracemalloc

    encode, decoder, _ = coder({c: 2**i for i, c in enumerate("abcdefgh ")})
    text = "".join(random.Random(1).choices("abcdefgh ", range(1, 10), k=200_000)) * 20
    start = time.perf_counter()
    tracemalloc.start()
    data, pad, blocks = encode(text)
    assert tracemalloc.get_traced_memory()[1] < 2 * len(data) + 100 * codebook.PORTION + 64 * len(blocks)
    tracemalloc.reset_peak()
    (back,) = decoder.texts([(data, pad, blocks)])
    assert tracemalloc.get_traced_memory()[1] < 16 * len(data) + 3 * len(text) + 12 * codebook.LANES * codebook.BLOCK
    tracemalloc.stop()
    assert back == text and time.perf_counter() - start < 30


def test_decoding_without_blocks(spark, rows):
    texts = ["the same text " * 100, "", None, "x"]
    df = corpus(spark, *texts)
    book = codebook.codebook(codebook.symbol_histogram(df, "text")).cache()
    packed = codebook.encode_corpus(df, book, "text")
    assert rows(codebook.decode_corpus(packed.drop("blocks"), book), "id", "decoded") == list(enumerate(texts))


def test_texts_are_counted_in_portions(spark):
    """Neither a batch nor a long text is counted at once; a task gives a row per symbol, however many batches it has."""
    texts = ["a" * (2 * codebook.PORTION + 7), None, "", "bc" * 40_000, "é\U0001f600"] * 2
    portions = [*codebook._symbols(pa.array(texts))]
    assert max(map(len, portions)) < 2 * codebook.PORTION and "".join(portions) == "".join(t or "" for t in texts)
    many = spark.createDataFrame([("ab",)] * 25_000, "text string").coalesce(1)  # three batches
    counted = codebook.symbol_histogram(many, "text")
    assert sorted(tuple(r) for r in counted.collect()) == [("a", 25_000), ("b", 25_000)]


def test_rows_are_handed_on_in_portions(spark):
    """Rows of a batch leave an encoder and a decoder some at a time, each next to its own."""
    texts = [None if i % 7 == 0 else "" if i % 5 == 0 else f"{i} " * (i % 11) for i in range(2 * codebook.ROWS + 9)]
    docs = corpus(spark, *texts, "x" * 200_000, "y").coalesce(1)
    book = codebook.codebook(codebook.symbol_histogram(docs, "text"))
    got = codebook.decode_corpus(codebook.encode_corpus(docs, book, "text"), book, "decoded").collect()
    assert len(got) == len(texts) + 2 and all(r.text == r.decoded for r in got)
