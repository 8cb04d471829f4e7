"""Scores on held-out documents, the automaton, and odd inputs."""

import random
import zlib

import pytest

from fleetlens.llm import queries, toxicity

from .conftest import ODD


def edits(a, b):
    """Optimal string alignment, written plainly."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not (i and j)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_one_edit():
    rng = random.Random(8)
    words = {"".join(rng.choices("abc", k=rng.randrange(4, 8))): float(i + 1) for i in range(25)}
    trie = toxicity.Trie({}, words)
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randrange(1, 9)))
        if word not in words:
            want = max((w for t, w in words.items() if len(t) >= 5 and edits(word, t) == 1), default=0.0)
            assert trie.near(word) == want, word


def test_stems_and_words():
    trie = toxicity.Trie({"vequ": 3.0}, {"idiot": 4.0})
    assert [trie.exact(w) for w in ("vequla", "vequ", "veq", "idiot", "idiots", "idio")] == [3.0, 3.0, 0.0, 4.0, 0.0, 0.0]
    assert [trie.near(w) for w in ("idiots", "idot", "idoit", "1diot", "xdiots")] == [4.0, 4.0, 4.0, 4.0, 0.0]


def test_misspelled_stems_and_marked_letters():
    inflected = {"dummkopfes": 3.0, "vequla": 2.0}
    model = toxicity.Model({"dummk": 3.0, "vequ": 2.0}, {"idiot": 4.0, "shit": 5.0}, inflected=inflected)
    chunk = toxicity.Scorer(model).chunk
    for word, weight in [
        ("dumkopfes", 3.0), ("dumkmopfes,", 3.0), ("dunmkopfes", 3.0), ("veqlua", 2.0), ("veula", 2.0), ("id1ot", 4.0),
        ("idi*t!", 4.0), ("1diot", 4.0), ("idi-ot", 4.0), ("1d1ot", 4.0), ("sh1t", 5.0), ('"$hit"', 5.0), ("veq*la", 2.0),
        ("d*mmkopfes", 3.0),
    ]:
        assert chunk(word) == toxicity.NEAR * weight, word
    assert [chunk(w) for w in ("dummkopfen", "vequlas", "idiot", "shit.")] == [3.0, 2.0, 4.0, 5.0]
    for word in ("ship", "requlx", "12:34", "a1", "x" * 100_000, "x1" * 100_000, "well-known", "s**t"):
        assert chunk(word) == 0.0, word[:20]


def test_stems_of_a_text_and_its_contexts_agree(spark):
    text = "vequ vequlas dummkopfes ab abcdefghi abcdefghij"
    both = toxicity.term_contexts(spark.createDataFrame([(text,)], "text string")).collect()
    assert toxicity.terms_of(text) == {(r.term, r.stem) for r in both} and ("vequ", True) in toxicity.terms_of("Vequ")


def test_lexicon_keeps_words_of_stems(spark):
    toxic = [(f"{a} you {w} {b}", True) for w in ("vequla", "vequbo", "vequdi") for a in "abcdefgh" for b in "ijkl"]
    sample = spark.createDataFrame(toxic + [(f"fine words {i}", False) for i in range(99)], "text string, toxic boolean")
    stems, words, inflected = toxicity.lexicon(sample, len(toxic), 99, 100)
    assert "vequ" in stems and not {"vequla", "vequbo"} & words.keys() and {"vequla", "vequbo", "vequdi"} <= inflected.keys()


def test_mentions_count_less():
    scorer = toxicity.Scorer(toxicity.Model({}, {"idiot": 4.0}, (1.0, 0.0, 0.0, 0.0, 0.0)))
    used, quoted, said, near = (scorer.features(t)[0] for t in ("you are an idiot", 'the word "idiot" here', "he wrote idiot once", "you idoit"))
    assert quoted < used and said < used and near < used and min(quoted, said, near) > 0


def test_held_out_documents(spark, tables):
    sf = "/root/testdata/sf0.1"
    truth = dict(tables("select doc_id, toxic from labels", "sf0.1"))
    rows = queries.op10_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in held)
    assert hit / sum(p for p, _ in held) > 0.95 and hit / sum(t for _, t in held) > 0.7


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


@pytest.mark.parametrize("rows_of_labels", [[], [(1, 0), (2, None), (None, 1)], [(i, i % 2) for i in range(11)] + [(5, 0)]])
def test_odd_inputs(spark, odd, empty, rows, rows_of_labels):
    labels = spark.createDataFrame([(i, None, t) for i, t in rows_of_labels], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == len(ODD) and got.filter("score is null or held_out is null").isEmpty()
    assert toxicity.toxicity(empty, labels).isEmpty()
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
