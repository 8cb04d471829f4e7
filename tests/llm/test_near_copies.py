"""Near copies at a similarity of word shingles, against all pairs."""

import random

import numpy as np
import pytest

from fleetlens.llm import near_copies

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdgklmnprst"]


def shingles(text, k=5):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(WORDS) + "x"
    return " ".join(out)


def brute_groups(texts):
    """The smallest id that links of at least 0.8 reach, by id."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def kept_ids(docs, **parameters):
    return sorted(r.doc_id for r in near_copies.drop_near_copies(docs, **parameters).collect())


@pytest.mark.parametrize("size, low, mid, high", [(2, 0.9, 0.95, 0.98), (3, 0.7, 0.85, 0.95)])
def test_chance_that_a_pair_meets(size, low, mid, high):
    rng = random.Random(5)
    for words, replaced, at_least in ((270, 6, low), (270, 4, mid), (300, 2, high)):  # 0.80, 0.86, 0.93
        met = []
        for _ in range(150):
            text = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)]
            a, b = " ".join(text), changed(rng, text, replaced)
            assert similarity(a, b) >= 0.79
            x, y = (near_copies.fingerprint(near_copies.shingle_hashes(t)) for t in (a, b))
            same = x == y
            places = [[i, *((i + s) % near_copies.BYTES for s in steps)] for steps in near_copies.STEPS[size] for i in range(24)]
            names, whole = np.bitwise_count(x[24:] ^ y[24:]).sum(), np.bitwise_count(x ^ y).sum()
            few = names <= near_copies.NAME_BITS and whole <= near_copies.ALL_BITS
            met.append(few and any(same[p].all() for p in places))
        assert np.mean(met) >= at_least, (words, replaced, np.mean(met))


@pytest.mark.parametrize("wide_rows", [near_copies.WIDE_ROWS, 0])
def test_groups(spark, docs, wide_rows):
    rng, texts, n = random.Random(7), {}, 0
    for _ in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(60, 400))]
        for copy in range(rng.choice([1, 1, 2, 3])):
            texts[n] = changed(rng, words, max(1, len(words) // 150) * copy)
            n += 1
    # Alike in half their words only, and an order of words that no other has.
    shared = [rng.choice(WORDS) for _ in range(100)]
    for _ in range(10):
        texts[n] = " ".join(shared + [rng.choice(WORDS) for _ in range(100)])
        n += 1
    groups = brute_groups(texts)
    want = {i for i, g in groups.items() if i == g}
    got = set(kept_ids(docs(texts.items()), wide_rows=wide_rows))
    assert want <= got  # only what has a copy that stays may go
    assert len(texts) - len(got) >= 0.9 * (len(texts) - len(want))


def test_a_large_group(spark, docs):
    """Lists of hundreds of members: copies of one text, half of them alike to the text only."""
    rng = random.Random(3)
    words = [rng.choice(WORDS) for _ in range(300)]
    texts = {1000 + i: changed(rng, words, rng.choice([1, 2, 5])) for i in range(600)} | {5000: " ".join(words)}
    other = [rng.choice(WORDS) for _ in range(300)]
    texts |= {2000 + i: changed(rng, other, 1) for i in range(300)}
    groups = brute_groups(texts)
    want = sum(i == g for i, g in groups.items())
    got = kept_ids(docs(texts.items()))
    assert want <= len(got) <= want + 0.05 * len(texts)


def test_pairs_across_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    names = np.unique(base[rng.integers(0, 5, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    groups = rng.integers(0, 9, len(names))
    want = {
        (min(a, b), max(a, b))
        for i, a in enumerate(names.tolist())
        for j, b in enumerate(names.tolist())
        if groups[i] != groups[j] and (a ^ b).bit_count() <= near_copies.NAME_BITS
    }
    old, near_copies.CELLS = near_copies.CELLS, 1000
    try:
        got = {(min(a, b), max(a, b)) for x, y in near_copies.across(names, groups) for a, b in zip(x.tolist(), y.tolist())}
    finally:
        near_copies.CELLS = old
    assert got == want


def test_odd_rows(docs, odd, empty):
    assert near_copies.drop_near_copies(empty).columns == empty.columns
    assert near_copies.drop_near_copies(empty).isEmpty()
    got = near_copies.drop_near_copies(odd)
    assert got.columns == odd.columns
    # 2, 3, 10 and a null id are as wordless as 1; of the repeated row 5 one stays; the null id has a text of its own.
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(i for i, _ in rows if i is not None) == [1, 4, 5, 6, 7, 8, 9]
    assert [t for i, t in rows if i is None] == ["same text as nothing else here"]
    clash = docs([(1, "a b c d e f"), (2, "A b c d e f")]).withColumnRenamed("score", "_kept_row")
    kept = near_copies.drop_near_copies(clash)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [1]


def test_a_long_text(docs):
    rng = random.Random(1)
    words = [rng.choice(WORDS) for _ in range(200_000)]
    got = kept_ids(docs([(3, " ".join(words)), (2, changed(rng, words, 500)), (1, " ".join(words[100_000:]))]))
    assert got == [1, 2]


def test_pairs_do_not_depend_on_the_size(spark):
    """Beyond ``wide_rows`` the same names are linked: their lists are by as many bytes as before, only compared in turns."""
    rng, texts = random.Random(11), []
    for _ in range(60):
        words = [rng.choice(WORDS) for _ in range(270)]
        texts += [" ".join(words), changed(rng, words, 5)]  # a similarity of about 0.83
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    one, other = ({tuple(r) for r in near_copies.group_rows(rows, wide_rows=w).collect()} for w in (near_copies.WIDE_ROWS, 0))
    assert one == other and len({root for _, root in one}) < 70
    narrow = near_copies.group_rows(rows, list_bytes=3).collect()
    assert {r.row for r in narrow} == {row for row, _ in one}


def variants(spark, n, seed=13):
    """Copies of one text, most of them near each other by their bits but not alike."""
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(200)]
    texts = [changed(rng, words, rng.choice([2, 3, 3, 4])) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "row long, text string"), texts


def test_no_more_pairs_than_names_are_joined_to_texts(spark, monkeypatch):
    """A group whose near pairs are many more than its names: what meets its texts are rows of names."""
    counts = {"verified": [], "links_within": []}
    for name, made in counts.items():
        step = getattr(near_copies, name)
        monkeypatch.setattr(near_copies, name, lambda rows, *a, step=step, made=made: (made.append(rows.count()), step(rows, *a))[1])
    rows, texts = variants(spark, 200)
    whole = [near_copies.fingerprint(near_copies.shingle_hashes(t)) for t in texts]
    wide = np.stack(whole).view(np.uint64)
    i, j = np.triu_indices(len(texts), 1)
    close = near_copies.near(wide[i, 3], wide[j, 3]) & near_copies.all_near(wide[i], wide[j])
    close &= near_copies.meet(wide[i], wide[j], near_copies.STEPS[2])
    assert close.sum() > 5 * len(texts)
    near_copies.group_rows(rows).collect()
    assert sum(counts["verified"]) <= len(texts) and sum(counts["links_within"]) <= len(texts), counts


def test_a_pair_has_its_own_b(spark):
    """Of each name one pair at most has it as ``b``, so that its text is moved once; the other name may be in many."""
    pairs = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5), (6, 7), (5, 8)], "a long, b long")
    got = {(r.a, r.b) for r in near_copies.one_each(pairs).collect()}
    assert got == {(5, 1), (5, 2), (5, 3), (5, 4), (6, 7), (5, 8)}


def test_texts_outside_of_blocks_stay(spark, monkeypatch):
    """Only texts of names that are in blocks are joined to fingerprints, however many others there are."""
    seen, of_names = [], near_copies.of_names
    cells = spark.createDataFrame([(n, 0, 0, 0, 0, high) for n in (1, 2) for high in (0, 1)], "name long, component long, family long, block int, low int, high int")
    prints = spark.createDataFrame([(n, bytes(32)) for n in range(50)], "name long, bytes binary")
    texts = spark.createDataFrame([(n, f"t{n}") for n in range(50)], "name long, text string")
    monkeypatch.setattr(near_copies, "of_names", lambda *a: (seen.append(of_names(*a)), seen[-1])[1])
    got = sorted((r.name, r.high, r.text) for r in near_copies.with_texts(cells, prints, texts).collect())
    assert got == [(1, 0, "t1"), (1, 1, "t1"), (2, 0, "t2"), (2, 1, "t2")]
    assert [s.count() for s in seen] == [2, 2]


def test_blocks_lose_no_link(spark, monkeypatch):
    rows, texts = variants(spark, 200)
    whole = {tuple(r) for r in near_copies.group_rows(rows).collect()}
    block_pairs, cut = near_copies.block_pairs, []

    def small(members, block_rows, block_chars):
        cut.append(block_pairs(members, 30, block_chars))
        return cut[-1]

    monkeypatch.setattr(near_copies, "block_pairs", small)
    assert {tuple(r) for r in near_copies.group_rows(rows).collect()} == whole
    assert cut[0].select("high").distinct().count() > 3
    groups = brute_groups(dict(enumerate(texts)))
    roots = dict(whole)
    assert all(groups[row] == groups[root] for row, root in roots.items())  # only alike texts are linked
    assert len(set(roots.values())) < len(texts)


def test_bridges_join_families_once():
    rng = np.random.default_rng(2)
    flips = (np.uint8(1) << rng.integers(0, 8, (90, 32)).astype(np.uint8)) * (rng.random((90, 32)) < 0.4)
    prints = rng.integers(0, 256, (3, 32), dtype=np.uint8)[rng.integers(0, 3, 90)] ^ flips
    names, first = np.unique(np.ascontiguousarray(prints[:, 24:]).view(np.int64).ravel(), return_index=True)
    prints, n = prints[first], len(first)
    families = rng.integers(0, 20, n)
    held = [np.zeros(n, np.int64), names, families, np.array([p.tobytes() for p in prints], object)]
    found = [(int(x), int(y)) for a, b in near_copies.bridges(held) for x, y in zip(a.view(np.int64), b.view(np.int64))]
    family, root = dict(zip(names.tolist(), families.tolist())), list(range(20))
    assert found and all(near_copies.unite(root, int(family[x]), int(family[y])) for x, y in found)
    wide = prints.view(np.uint64)
    for i in range(n):
        for j in range(i):
            if near_copies.near(wide[i, 3], wide[j, 3]) and near_copies.all_near(wide[i], wide[j]):
                assert not near_copies.unite(root, int(families[i]), int(families[j]))
