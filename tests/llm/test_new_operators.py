"""Personal data, conversation repair and hard negatives against plain versions of the same rules."""

import hashlib
import heapq
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from fleetlens.llm import conversations as conv, hard_negatives as hard, personal_data as pii, queries

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple((v is not None, v) for v in r)


# Personal data


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_entities(text):
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 10 <= len(digits) <= 15,
        }[kind]()

    out = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def pii_row(i, text):
    found = plain_entities(text or "")
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (i, *[sum(s[0] == k for s in found) for k in PLAIN], hashlib.sha256(listed.encode()).hexdigest(), listed)


def test_entities_are_the_patterns():
    rng = random.Random(11)
    letters = [*"ab@.-_%+ ()0123456789", ".", "@", "1.2.3.4", "a@b.c", "+1 ", "4111 1111 1111 1111", "+1 (555) 555-0100", "é", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(letters, k=rng.randrange(24)))
        assert pii.entities(text) == plain_entities(text), repr(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "a.", "1 ", "+1", "a@a.", "+1 (", "1-", "@", ". "])
def test_long_texts_take_linear_time(unit):
    start = time.perf_counter()
    pii.entities(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 5


def test_personal_data_of_the_tables(spark, rows, tables, odd, empty):
    texts = tables("select doc_id, text from documents")
    found = rows(queries.op11_personal_data(spark, SF))
    want = {r[0]: r for r in (pii_row(i, t) for i, t in texts)}
    assert len(found) == len(want) and all(r[:6] == want[r[0]][:6] for r in found)
    base = ",".join(pii.BASE)
    for r in found:
        assert ",".join(s for s in r[6].split(",") if s.split(":")[0] in base and s) == want[r[0]][6]
    assert rows(pii.personal_data_report(pii.find_personal_data(odd))) == sorted((pii_row(i, t) for i, t in ODD), key=key)
    assert rows(pii.personal_data_report(pii.find_personal_data(empty))) == []


def plain_disclosures(texts):
    """Entities and words in plain counts."""
    lower = lambda s: s.translate(str.maketrans(pii.common.UPPER, pii.common.LOWER))
    near, around, has, words = {}, {}, {}, {}
    for d, text in enumerate(texts):
        found = pii.entities(text)
        inside = {i for _, a, b in found for i in range(a, b)}
        runs = [(m.start(), m.end()) for m in re.finditer(pii.WORD, text)]
        for a, b in runs:
            words.setdefault(lower(text[a:b]), set()).add(d)
        for kind, a, b in found:
            name = pii.named(kind, text[a:b])
            has.setdefault(name, set()).add(d)
            some = [
                lower(text[x:y]) for x, y in runs
                if not inside & set(range(x, y)) and (a - 100 <= x and y <= a or b <= x and y <= b + 100)
            ]
            for w in set(some):
                near.setdefault((name, w), set()).add(d)
                around.setdefault((name, w), set()).add(tuple(some))
    out = set()
    for (name, w), docs in near.items():
        missing = math.log2(len(words[w]) / len(docs))
        bits = math.log2(len(docs) * len(texts) / (len(has[name]) * len(words[w])))
        if len(around[name, w]) >= 3 and missing <= 2 and bits >= 3:
            out.add((name, w, len(docs), len(words[w]), len(has[name]), "remove" if missing <= 1 else "generalise"))
    return out


def told_texts():
    rng = random.Random(5)
    plain = [f"w{i}x" for i in range(60)]
    some = lambda n: " ".join(rng.choices(plain, k=n))
    texts = [f"{some(30)}." for _ in range(120)]
    for i in range(4):  # a name and a nickname next to an address; the nickname elsewhere, too
        texts.append(f"{some(20)} Quillon {'Zed' + 'ric'} wrote, {some(2)} q.z@mail{i % 1}.example.com {some(20)}")
    texts += [f"{some(10)} zedric {some(8)}" for _ in range(9)]
    texts += ["the same Copyword 10.1.2.3 passage here"] * 6  # one surrounding only
    texts += [f"{some(4)} info@all.example.com {some(5)}" for _ in range(160)]  # so frequent that nothing gives it away
    return texts


def test_words_that_give_entities_away(spark, docs, rows):
    texts = told_texts()
    table = docs(list(enumerate(texts)))
    found = pii.disclosures(table).collect()
    got = {(r.entity, r.word, r.n_both, r.n_word, r.n_entity, r.level) for r in found}
    assert got == plain_disclosures(texts)
    levels = {r.word: r.level for r in found}
    assert levels["quillon"] == "remove" and levels["zedric"] == "generalise"
    assert "copyword" not in levels and "passage" not in levels
    clean = {r.doc_id: r for r in pii.find_personal_data(table).collect()}
    told = clean[121].sanitised
    assert "Quillon" not in told and "[name]" in told and "[email]" in told
    for i, r in clean.items():
        for s in r.spans:
            word = texts[i][s.start : s.end].lower()
            assert s.kind in pii.BASE or levels[word] == s.kind
        wanted = sum(len(re.findall(rf"\b{w}\b", texts[i], re.IGNORECASE)) for w in levels)
        assert sum(s.kind not in pii.BASE for s in r.spans) == wanted
    # Repeated rows and a row order of its own change nothing else.
    again = pii.find_personal_data(table.repartition(7), pii.disclosures(table))
    assert rows(again.drop("sanitised")) == rows(pii.find_personal_data(table).drop("sanitised"))


# Conversations


TURNS = "conv_id long, turn long, role string, text string, edit string, costs int, symbols string"


def plain_damage(turns):
    out = []
    for c, t, role, text in turns:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """Dijkstra over (turns taken, state), by cost and then audit."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    todo, done = [(0, "", 0, "", ())], set()
    best = None
    while todo:
        cost, audit, at, state, made = heapq.heappop(todo)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        for i, role in (("u", "user"), ("a", "assistant")):
            if (state, i) in step:
                heapq.heappush(todo, (cost + 2, audit + "I", at, i, (*made, f"{role}:")))
        if at < len(turns):
            _, _, role, text = turns[at]
            heapq.heappush(todo, (cost + 3, audit + "D", at + 1, state, made))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "cut"
                if (state, role[:1]) in step:
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, role[:1], (*made, f"{role}:{text}")))
                for i, other in (("u", "user"), ("a", "assistant")):
                    if (state, i) in step:
                        heapq.heappush(todo, (cost + 2 + more, audit + "R", at + 1, i, (*made, f"{other}:{text}")))
    numbers = [t for _, t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[2][:1] for r in turns]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    counts = [sum(f == k for f in faults) for k in ("blank", "duplicate", "cut")]
    return (gaps, *counts, illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()), best[2]


def plain_report(turns, ids):
    groups = {i: [] for i in ids}
    for r in turns:
        groups.setdefault(r[0], []).append(r)
    return sorted(((i, *plain_repair(g)[0]) for i, g in groups.items()), key=key)


def odd_turns(seed, n, long=()):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u", "assistant", "user"]
    texts = ["Hi.", "yes", "no!", "", " \n", None, "What?\t", "dots..", "é", "ok \x85"]
    out = []
    for c in [*range(n), None]:
        for _ in range(rng.randrange(9)):
            out.append((c, rng.choice([None, 0, 1, 2, 3, 5, -4, 1030, 2**40]), rng.choice(roles), rng.choice(texts)))
    for c, turns in enumerate(long, n):
        out += [(c, t, rng.choice(roles[:2] * 6 + roles), rng.choice(texts) or f"t{t}.") for t in range(turns)]
    return out


def table_of(spark, turns):
    return spark.createDataFrame([(*t, "K", 1, "x") for t in turns], TURNS)


def test_matrices_are_shortest_paths():
    rng = random.Random(2)
    rules = ["ua", chr(256) + chr(256), "xU", chr(257) + "s", chr(256) + "A"]
    known = conv.matrices(rules)
    spelled = {s: s for s in conv.SYMBOLS}
    for i, (x, y) in enumerate(rules):
        spelled[chr(256 + i)] = spelled[x] + spelled[y]
    for _ in range(300):
        text = "".join(rng.choices(sorted(known), k=rng.randrange(1, 6)))
        row = conv.INSERTS[0]
        for symbol in text:
            row = conv.applied(row, known[symbol])
        other = conv.INSERTS[0]
        for symbol in "".join(spelled[s] for s in text):
            other = conv.applied(other, conv.terminal(symbol))
        flat = lambda r: [e and (e[0], conv.flat(e[1])) for e in r]
        assert flat(row) == flat(other)


def test_ropes_compare_as_strings():
    rng = random.Random(3)
    ropes = ["K", "D", "I", "RK", ""]
    for _ in range(400):
        ropes.append(conv.joined(rng.choice(ropes[-30:]), rng.choice(ropes)))
        x, y = rng.choice(ropes), rng.choice(ropes)
        assert conv.before(x, y) == (conv.flat(x) < conv.flat(y))


def test_repairs_are_the_cheapest(spark, rows, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK_TURNS", 8)
    turns = odd_turns(7, 150, long=(40, 90, 200))
    table = table_of(spark, turns)
    assert rows(conv.damaged(table)) == sorted(plain_damage(turns), key=key)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns]
    assert rows(conv.repair_report(table)) == plain_report(filled, {t[0] for t in turns})
    made = conv.repaired(table).collect()
    for c in {t[0] for t in turns}:
        mine = sorted((r.position, f"{r.role}:{r.text}") for r in made if r.conv_id == c)
        want = plain_repair([t for t in filled if t[0] == c])[1]
        assert mine == list(enumerate(want))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for _, t in mine))


def test_damaged_conversations_are_repaired(spark, rows, tables):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_report(plain_damage(turns), {t[0] for t in turns})
    assert rows(queries.op12_conversation_repair(spark, SF)) == want
    odd = odd_turns(1, 60)
    table = table_of(spark, odd)
    assert rows(conv.repair_report(conv.damaged(table), table)) == plain_report(plain_damage(odd), {t[0] for t in odd})


def test_conversations_without_turns(spark, rows):
    none = table_of(spark, [])
    assert rows(conv.repair_report(none)) == [] and rows(conv.repaired(none)) == []
    nothing = hashlib.sha256(b"").hexdigest()
    ids = table_of(spark, [(3, 0, "user", "x."), (None, 1, "a", "b")])
    assert rows(conv.repair_report(none, ids)) == [(3, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)][::-1]


def test_one_long_conversation(spark, rows):
    """One conversation holds nearly all rows, with a very long text; its turns are counted and repaired in chunks."""
    turns = [(0, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(6000)]
    turns += [(0, 6000, "user", "long " * 200_000), (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")]
    found = {r[0]: r for r in rows(conv.repair_report(table_of(spark, turns)))}
    assert found[1][6:8] == (0, "KK") and found[0][6:8] == (3, "K" * 6000 + "D")
    assert found[0][:6] == (0, 0, 0, 0, 1, 0)


# Hard negatives


def plain_negatives(vectors):
    """All scores, in Python's integers."""
    rows = []
    for i, (vec_id, label, x) in enumerate(vectors):
        if label is not None and x and all(c is not None and math.isfinite(c) and math.isfinite(c * 256) for c in x):
            if vec_id is not None and vec_id % 7 == 0:
                label = int(math.fmod(label + 1, 10))
            rows.append((i, vec_id, label, [math.floor(c * 256) for c in x]))
    last = 2**63
    out = []
    for a in rows:
        if a[1] is None or a[1] % 100:
            continue
        scored = [(sum(p * q for p, q in zip(a[3], r[3])), r) for r in rows if r[0] != a[0] and len(r[3]) == len(a[3])]
        scored.sort(key=lambda s: (-s[0], last if s[1][1] is None else s[1][1], s[1][0]))
        for score, positive in [s for s in scored if s[1][2] == a[2]][:5]:
            fits = [s for s in scored if s[1][2] != a[2] and 80 * score <= 100 * s[0] <= 100 * score]
            out += [(a[1], positive[1], rank, n[1], score, s) for rank, (s, n) in enumerate(fits[:5], 1)]
    return sorted(out, key=key)


VECTORS = "vec_id long, label int, embedding array<double>, row long, leaf string, score double, tag int"


def vector_table(spark, vectors):
    return spark.createDataFrame([(*v, 1, "x", 0.5, 2) for v in vectors], VECTORS)


def random_vectors(seed, n, dims=12, groups=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    x = centres[rng.integers(0, groups, n)] + 0.3 * rng.standard_normal((n, dims))
    return [(int(i), int(rng.integers(0, 4)), [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)]


SMALL = dict(sample_rows=400, leaf_rows=40, points=5, block_rows=32, block_anchors=4)


def test_hard_negatives_of_the_table(spark, rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.label, list(r.embedding)) for r in table.collect()]
    want = plain_negatives(vectors)
    assert rows(queries.op13_hard_negatives(spark, SF)) == want and want
    assert rows(hard.hard_negatives(hard.moved_labels(table), **SMALL)) == want


def test_hard_negatives_in_a_deep_tree(spark, rows):
    vectors = random_vectors(4, 900)
    vectors += [(900 + i, i % 4, vectors[0][2]) for i in range(300)]  # a third are one vector
    table = hard.moved_labels(vector_table(spark, vectors))
    assert rows(hard.hard_negatives(table, **SMALL)) == plain_negatives(vectors)
    assert rows(hard.hard_negatives(table.repartition(9), **SMALL)) == plain_negatives(vectors)


def test_hard_negatives_of_odd_rows(spark, rows):
    vectors = random_vectors(6, 320, dims=4)
    nan, inf = float("nan"), float("inf")
    vectors += [
        (400, None, [1.0] * 4), (500, 1, None), (600, 1, []), (700, 1, [nan, 1.0, 1.0, 1.0]), (800, 1, [None, 1.0, 1.0, 1.0]),
        (900, 1, [inf] * 4), (1000, 1, [0.0] * 4), (1100, -1, [1.0, 2.0]), (1101, 2, [1.0, 2.0]), (1102, -1, [1.0, 2.1]),
        (None, 1, [0.5] * 4), (None, 2, [0.5] * 4), (1200, 1, [0.5] * 4), (1200, 1, [0.5] * 4), (1200, 2, [0.5] * 4), (1301, 0, [-1.0] * 4),
    ]
    table = hard.moved_labels(vector_table(spark, vectors))
    assert rows(hard.hard_negatives(table, **SMALL)) == plain_negatives(vectors)
    assert rows(hard.hard_negatives(hard.moved_labels(vector_table(spark, [])))) == []
    few = [(100, 1, [1.0, 1.0]), (101, 1, [0.5, 1.0]), (102, 2, [0.5, 0.9])]
    assert rows(hard.hard_negatives(hard.moved_labels(vector_table(spark, few)))) == plain_negatives(few)


@pytest.mark.parametrize("size", [1.0, 3e5, 1e7, 1e60, 1e150])
def test_scores_are_exact_at_any_size(spark, rows, size):
    vectors = [(i, lab, [c * size for c in x]) for i, lab, x in random_vectors(8, 150, dims=3)]
    table = hard.moved_labels(vector_table(spark, vectors))
    want = plain_negatives(vectors)
    if size < 1e8:
        assert rows(hard.hard_negatives(table, **SMALL)) == want
    else:  # beyond a long, scores are cut off in the result
        assert hard.hard_negatives(table, **SMALL).count() >= 0
    whole = hard.scores(*[np.floor(np.array([v[2] for v in vectors]) * 256)] * 2)
    exact = [[math.floor(c * 256) for c in v[2]] for v in vectors]
    assert all(int(whole[i, j]) == sum(map(int.__mul__, exact[i], exact[j])) for i, j in itertools.product(range(0, 150, 29), range(150)))


def test_the_tree_leaves_siblings_out():
    """Rings of well-parted groups miss the other groups' leaves, and never a vector within a ring."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 16))
    centres *= rng.uniform(0.2, 1, (10, 1))
    x = np.floor(256 * (centres[rng.integers(0, 10, 2000)] + 0.02 * rng.standard_normal((2000, 16))))
    longest = float((x**2).sum(axis=1).max())
    tree = hard.Tree(longest, x[:800], 60, 8)
    leaf, ranges = tree.placed(x)
    found = hard.scores(x[:100], x)
    top = np.sort(found, axis=1)[:, -20]
    rings = np.array([[hard.ring(v, longest, int(t), None)] for v, t in zip(x, top)])
    reached = {}
    for at, some in tree.reached(x[:100], rings, ranges):
        for a in some:
            reached.setdefault(int(a), set()).add(at)
    for a in range(100):
        assert set(leaf[found[a] >= top[a]]) <= reached[a]
    assert np.mean([len(r) for r in reached.values()]) < tree.leaves / 2
