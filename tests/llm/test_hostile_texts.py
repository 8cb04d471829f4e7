"""Very long words and texts made to be slow: linear time, and results as those of the library or a slow version."""

import base64
import random
import time

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import bpe, common, secret_scan, token_counts

from .test_text_operators import der

WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.Merges(WORDS))


@pytest.mark.parametrize(
    "word",
    [
        "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)),
        "a" * 1_000_000, "ab" * 300_000 + "a", "日本語タイ" * 40_000, "ÄÖ" * 100_000,
    ],
    ids=["letters", "equal", "pairs", "no spaces", "capitals"],
)
def test_long_words_are_counted_as_the_library_does(counter, word):
    start = time.perf_counter()
    found = counter.counts([f"one {word} two", "x"])
    assert time.perf_counter() - start < 30
    tok = Tokenizer.from_file(WORDS)
    assert found == [len(tok.encode(t, add_special_tokens=False).ids) for t in (f"one {word} two", "x")]
    assert word not in counter.words and max(map(len, counter.words)) <= common.MEMO_CHARS


def test_long_and_short_merging_agree(counter):
    rng, merges = random.Random(2), counter.merges
    for letters in ("ab", "theinagr", "aaab", "etaoinshrdlu"):
        for n in (1, 2, 3, 10, 400):
            piece = "".join(rng.choices(letters, k=n)).encode()
            assert merges.long_count(piece) == merges.short_counts([piece])[0]


def test_memos_hold_no_long_keys():
    enc = bpe.Encoder(bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    texts = [f"a {'long' * 50_000} b", f"the {'word' * 5000}", "short words"]
    first = enc.encode_all(texts)
    assert enc.encode_all(texts) == first
    for memo in (enc.words, enc.pieces):
        assert max(map(len, [*memo.young, *memo.old]), default=0) <= common.MEMO_CHARS


UNITS = ["3084", "3082", "308200203082", "30820100020100", "MIIC", "MIIEvQIBADAN", "eyJhIjox", "eyJhIjp7", "aeyJhIjpb", "eyIi", "b3BlbnNzaC1rZXktdjE", "30"]


@pytest.mark.parametrize("unit", UNITS)
def test_secret_candidates_take_linear_time(unit):
    some = unit * (1_000_000 // len(unit))
    for text in (some, f"{some}.{some}.a"):
        start = time.perf_counter()
        secret_scan.spans(text)
        assert time.perf_counter() - start < 40


def test_keys_may_be_nested_deeply():
    """No depth is too deep, and one that doesn't fit at its end is unsound from every place."""
    inner = der(0x02, b"\1")
    for _ in range(40):
        inner = der(0x30, inner)
    key = der(0x30, der(0x02, b"\0") + der(0x04, b"k" * 20) + inner)
    assert secret_scan.private_key(key)
    assert [s[0] for s in secret_scan.spans(f"x {key.hex()} y") if s[0] != "hex"] == ["derhex"]
    assert [s[0] for s in secret_scan.spans(f"x {base64.b64encode(key).decode()} y")] == ["der"]
    cut = key[:-1]
    assert not secret_scan.private_key(cut) and secret_scan.broken(key) is None and secret_scan.broken(cut)
    deep = b""
    for _ in range(3000):
        deep = der(0x30, der(0x02, b"\0") + deep)
    start = time.perf_counter()
    assert not [s for s in secret_scan.spans((deep[:-3] + b"\x02\x05\0").hex()) if s[0] == "derhex"]
    assert time.perf_counter() - start < 20


def test_token_headers_at_any_place():
    """A header is found wherever it begins in a run, whatever stands before; one that isn't whole isn't."""
    make = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    head, load = make('{"alg":"HS256","typ":"JWT"}'), make('{"sub":"1"}')
    for before in ("", "a", "ab", "abc", "abcd", "eyJhIjox", make('{"a":') + "x", "eyJhIjp7" * 5):
        text = f"{before}{head}.{load}.sig"
        assert ("jwt", len(before), len(text)) in secret_scan.spans(text)
    for bad in (make('{"typ":"JWT"}'), make('{"alg":1}'), head[:-4], make('{"alg":"HS256"}x')):
        assert not [s for s in secret_scan.spans(f"{bad}.{load}.sig") if s[0] == "jwt"]
