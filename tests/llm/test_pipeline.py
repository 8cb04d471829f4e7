"""The stages, each against what it says of its own input."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers as P
from fleetlens.llm import common, exact_dedup, near_copies, packing, secret_scan, toxicity
from fleetlens.session import scratch_dir
from .test_near_copies import shingles

SF = "/root/testdata/sf0.01"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def similar_groups(texts):
    """Groups of ids that a similarity of at least 0.8 links, found by the shingles that texts share."""
    sets, holders, root = {i: shingles(t) for i, t in texts.items()}, {}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, own in sets.items():
        both = Counter(j for s in own or {()} for j in holders.get(s, ()))
        for j, n in both.items():
            if not own or n >= 0.8 * (len(own) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for s in own or {()}:
            holders.setdefault(s, []).append(i)
    groups = {}
    for i in texts:
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    assert all(after.columns == columns for name, (_, after) in seen.items() if name != "packing")

    before, after = seen["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in scored.collect() if not r.predicted}
    assert {r.doc_id for r in after.collect()} == want and len(want) < before.count()

    before, after = seen["exact dedup"]
    best = {}
    for r in before.collect():
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())

    before, after = seen["SimHash near-dedup"]
    texts, kept = {r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in after.collect()}
    groups = similar_groups(texts)
    want = {min(g) for g in groups}
    assert want <= kept and len(texts) - len(kept) >= 0.9 * (len(texts) - len(want)) > 0

    before, after = seen["secret scan"]
    clean = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        assert clean[r.doc_id].text == secret_scan.redact(r.text, secret_scan.spans(r.text))
        assert clean[r.doc_id].n_chars == len(clean[r.doc_id].text)

    before, after = seen["packing"]
    tokens = {r.doc_id: len(r.ids) // 4 for r in packing.token_ids(before, P.path("byte_bpe_50k.json"), 1).collect()}
    placed = {}
    for r in after.collect():
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == tokens


def test_run_has_the_last_stages_rows(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert not got.isEmpty()


def test_sequences_hold_the_tokens(spark):
    rows = corpus_pipeline.sequences(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select(columns).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(map(tuple, got))


def stored_documents(spark, path, n=240):
    """Rows in several files: some texts of many letters, copies and near copies among them, repeated and null ids."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(400)) for _ in range(n // 3)]
    texts += [t.upper() for t in texts[::2]] + [f"{t} more" for t in texts[::3]]
    rows = [(i // 2 if i % 7 else None, t, f"s{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "source").write.parquet(path)
    return spark.read.parquet(path)


def test_stages_do_not_copy_the_documents(spark, tmp_path):
    """Documents outlive a stage in its output alone: disk must not hold a copy of them for each stage."""
    docs = stored_documents(spark, str(tmp_path / "docs"))
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    whole, scratch = size(tmp_path / "docs"), Path(scratch_dir(spark).removeprefix("file:")).parent
    for stage in (corpus_pipeline.one_of_equal, corpus_pipeline.one_of_near):
        before = size(scratch)
        assert not stage(spark, docs, SF).isEmpty()
        assert size(scratch) - before < whole / 4, stage.__name__


def test_numbers_stay_and_are_unique(spark, tmp_path):
    docs = stored_documents(spark, str(tmp_path / "docs"))
    for table, stored in ((docs, True), (docs.filter("doc_id > 3"), True), (docs, False), (docs.limit(9), True)):
        marked = common.numbered(table, "mark", stored)
        assert marked.columns == [*docs.columns, "mark"]
        once, again = ({(r.mark, r.doc_id, r.source) for r in marked.collect()} for _ in range(2))
        assert once == again and len({m for m, _, _ in once}) == len(once) == table.count()
    made = spark.createDataFrame([(1, "a", "s"), (1, "a", "s")], docs.schema)  # not of files
    assert len({r.mark for r in common.numbered(made, "mark", True).collect()}) == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = {(r.mark, r.source) for r in common.numbered(docs, "mark", True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == {(r.mark, r.source) for r in common.numbered(docs, "mark", True).collect()}


def test_stored_documents_give_the_same_rows(spark, tmp_path):
    docs = stored_documents(spark, str(tmp_path / "docs"))
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows.collect())
    for step in (exact_dedup.drop_exact_duplicates, near_copies.drop_near_copies):
        got, want = step(docs, stored=True), step(docs)
        assert ids(got) == ids(want) and got.columns == want.columns and 0 < got.count() < docs.count()
