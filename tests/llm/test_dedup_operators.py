"""Duplicates of texts, lines and vectors against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from fleetlens.llm import common, embedding_dedup, exact_dedup, line_dedup, queries, simhash

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    links = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(0, i) for i in range(1, 300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "none": [],
    }[shape] + [(5000, 5000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])


def test_exact_groups(docs, rows, empty):
    texts = [(i, "Common Text" if i % 3 else "common text") for i in range(3000)] + [(i, f"own {i // 2}") for i in range(3000, 3100)]
    texts += [(9000, "tied"), (9000, "TIED"), (None, "tied"), (9001, None), (None, ""), (None, "É"), (None, "é")]
    table = docs(texts)
    for frequent in (1, 1000):
        rows_ = exact_dedup.decide(exact_dedup.digests(table), frequent, 1024).collect()
        assert len(rows_) == len(texts)
        groups = defaultdict(list)
        for r in rows_:
            groups[bytes(r.digest)].append(r)
        assert len(groups) == len({re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in texts})
        for g in groups.values():
            ids = [r.doc_id for r in g if r.doc_id is not None]
            assert {r.group_size for r in g} == {len(g)} and {r.keep_id for r in g} == {max(ids, default=None)}
            (kept,) = [r for r in g if r.kept]
            assert kept.doc_id == kept.keep_id
    kept = exact_dedup.drop_exact_duplicates(table)
    assert kept.columns == table.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).isEmpty()


def test_frequent_digests_are_few_and_true(spark, docs):
    texts = [(i, "hot") for i in range(2000)] + [(5000 + i, f"cold {i}") for i in range(4000)]
    winners = exact_dedup.frequent_winners(exact_dedup.digests(docs(texts)), 10, 256).collect()
    assert len(winners) <= 10 and (1999, 2000) in [(r.keep_id, r.group_size) for r in winners]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows(pairs):
    prints = [(i, fingerprint(t)) for i, t in pairs]
    distinct = sorted({p for _, p in prints})
    links = [(a, b) for n, a in enumerate(distinct) for b in distinct[:n] if (a ^ b).bit_count() <= 2]
    root = roots(distinct, links)
    least = defaultdict(list)
    for i, p in prints:
        least[root[p]] += [i] * (i is not None)
    return sorted(((i, f"{p:016x}", min(least[root[p]], default=None)) for i, p in prints), key=lambda r: tuple((v is not None, v) for v in r))


def test_simhash(spark, rows, tables, odd, empty):
    pairs = tables("select doc_id, text from documents", "sf0.01")
    assert rows(queries.op4_simhash(spark, SF)) == near_rows(pairs)
    assert rows(simhash.near_duplicates(odd)) == near_rows(ODD)
    assert simhash.near_duplicates(empty).isEmpty()
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({c for *_, c in near_rows(ODD)})


@pytest.mark.parametrize("spread", [3, 12, 16])
def test_links_join_all_that_are_near(spark, spread):
    """Fingerprints that differ in few places, so that lists are small and large."""
    rng = random.Random(spread)
    places = rng.sample(range(64), spread) if spread < 16 else [*range(8), *range(40, 48)]
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << p for p in places if rng.random() < 0.3) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    made = simhash.links(spark.createDataFrame(signed, "fingerprint long")).collect()
    found = roots(prints, [(r.a % 2**64, r.b % 2**64) for r in made])
    listed = sorted(prints)
    want = roots(prints, [(a, b) for n, a in enumerate(listed) for b in listed[:n] if (a ^ b).bit_count() <= 2])
    assert found == want


def test_lines(docs, rows, odd, empty):
    rng = random.Random(4)
    lines = ["a line that is long enough to count", " A LINE that is long enough to Count\t", "short", "", "É" * 20, "é" * 20] + [f"line number {i} which is long too" for i in range(30)]
    texts = [(i, "\n".join(rng.choices(lines, k=rng.randrange(12)))) for i in range(60)] + [(70, None), (None, lines[0]), (None, lines[6]), (3, lines[7])]
    norm = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    where = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            where[norm(x)].add(i)
    shared = {k: max((i for i in ids if i is not None), default=None) for k, ids in where.items() if len(k) >= 20 and len(ids) >= 3}
    want = []
    for i, t in texts:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (norm(x) in shared and shared[norm(x)] != i)]
        want.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert rows(line_dedup.drop_shared_lines(docs(texts))) == sorted(want, key=key)
    got = rows(line_dedup.drop_shared_lines(odd))
    assert got == sorted(((i, (t or "").count("\n") + 1, 0, t or "") for i, t in ODD), key=key)
    assert line_dedup.drop_shared_lines(empty).isEmpty()


def vector_rows(vectors, cosine=0.93):
    good = []
    for i, v, label in vectors:
        x = None if not v or None in v else np.array(v, dtype=np.float64)
        good.append(x if label is not None and x is not None and np.isfinite(x).all() and x.any() else None)
    links = []
    for a in range(len(vectors)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is not None and y is not None and vectors[a][2] == vectors[b][2] and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((a, b))
    n = Counter(i for link in links for i in link)
    root = roots(range(len(vectors)), links)
    least = defaultdict(list)
    for i in range(len(vectors)):
        least[root[i]] += [vectors[i][0]] * (vectors[i][0] is not None)
    return [(vectors[i][0], n[i], min(least[root[i]], default=None)) for i in range(len(vectors))]


def test_vectors(spark, rows, tables):
    vectors = tables("select vec_id, embedding, label from embeddings", "sf0.01")
    got = queries.op9_embedding_dedup(spark, SF)
    want = vector_rows(vectors)
    same = {r[0]: r for r in want}
    assert all(same[r.vec_id][1] == r.n_links and same[r.vec_id][2] == r.component_id for r in got.collect())
    assert got.filter("kept <> (vec_id = component_id)").isEmpty()


def test_recall_just_above_the_threshold(spark, tables):
    rng = np.random.default_rng(7)
    vectors = tables("select vec_id, embedding, label from embeddings", "sf0.01")
    for i, v, label in vectors[:250]:
        x = np.array(v, dtype=np.float64)
        noise = rng.standard_normal(len(x))
        noise -= noise @ x / (x @ x) * x
        tilt = np.arccos(rng.uniform(0.931, 0.95))
        y = np.cos(tilt) * x / np.linalg.norm(x) + np.sin(tilt) * noise / np.linalg.norm(noise)
        vectors.append((10_000 + i, y.astype(np.float32).tolist(), label))
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    want = {r[0]: r[1] for r in vector_rows(vectors)}
    assert sum(want.values()) >= 500 and sum(found.values()) >= 0.98 * sum(want.values())
    assert all(found[i] <= n for i, n in want.items())


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_odd_vectors_and_hot_buckets(spark, rows, block_rows):
    rng = np.random.default_rng(6)
    center = rng.standard_normal(16)
    vectors = [(i, (center + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(60)]
    vectors += [(100 + i, vectors[0][1], 1) for i in range(20)] + [(130, vectors[0][1], 2), (131, vectors[0][1], None)]
    inf, nan = float("inf"), float("nan")
    vectors += [(140, None, 1), (141, [], 1), (142, [0.0] * 16, 1), (143, [1.0, None] * 8, 1), (144, [inf] * 16, 1), (145, [nan] * 16, 1)]
    vectors += [(146, vectors[0][1][:8], 1), (5, vectors[5][1], 1), (None, vectors[3][1], 1), (None, None, None)]
    table = spark.createDataFrame([(*v, 1, True, 0) for v in vectors], "vec_id long, embedding array<float>, label int, row long, kept boolean, n long")
    got = embedding_dedup.near_duplicates(table, block_rows=block_rows)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert rows(got, "vec_id", "n_links", "component_id") == sorted(vector_rows(vectors), key=key)
    assert embedding_dedup.near_duplicates(table.limit(0)).isEmpty()


def test_chance_of_meeting():
    """The documented recall at the threshold itself."""
    same = 1 - np.arccos(0.93) / np.pi
    assert 1 - (1 - same**embedding_dedup.SIGNS) ** embedding_dedup.TABLES > 0.99
