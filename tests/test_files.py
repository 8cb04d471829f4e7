import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import inventory
from fleetlens.plans import queries
from fleetlens.sources import files, listings, stores


def grow(root, depth, dirs, per_dir):
    os.makedirs(root, exist_ok=True)
    for i in range(per_dir):
        with open(os.path.join(root, f"file{i}.txt"), "w") as f:
            f.write(str(i) * 8)
    if depth:
        for i in range(dirs):
            grow(os.path.join(root, f"dir{i}"), depth - 1, dirs, per_dir)


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    base = tmp_path_factory.mktemp("trees")
    grow(str(base / "flat"), 0, 4, 4)
    grow(str(base / "recursive"), 4, 2, 2)
    return base


@pytest.mark.parametrize("tree, n_files, n_dirs", [("flat", 4, 0), ("recursive", 62, 30)])
def test_scan(spark, trees, tree, n_files, n_dirs):
    found = files.scan_inventory(spark, [str(trees / tree)])
    counts = inventory.scan_counts(found).first()
    assert (counts.files, counts.dirs) == (n_files, n_dirs + 1)
    assert {r.size for r in found.filter("!is_dir").collect()} == {8}


def test_overlapping_roots_list_once(spark, trees):
    root = str(trees / "recursive")
    both = files.scan_inventory(spark, [root, f"{root}/dir0"])
    assert sorted(r.path for r in both.collect()) == sorted(r.path for r in files.scan_inventory(spark, [root]).collect())


def test_scan_prunes_like_the_filter(spark, trees):
    root = str(trees / "recursive")
    whole = files.scan_inventory(spark, [root])
    pruned = files.scan_inventory(spark, [root], exclude=["dir1"])
    assert pruned.count() < whole.count()
    listed = [sorted(r.path for r in inventory.exclude_paths(df, ["dir1"], [root]).collect()) for df in (whole, pruned)]
    assert listed[0] == listed[1]


def test_symlinks_and_missing_roots(spark, tmp_path):
    grow(str(tmp_path / "t"), 1, 1, 2)
    os.symlink(tmp_path / "t" / "file0.txt", tmp_path / "t" / "link")
    os.symlink(tmp_path / "t", tmp_path / "t" / "loop")
    found = files.scan_inventory(spark, [str(tmp_path / "t"), str(tmp_path / "gone")])
    by_path = {r.path: r for r in found.collect()}
    assert by_path[str(tmp_path / "t" / "link")].is_symlink
    assert by_path[str(tmp_path / "t" / "loop")].is_symlink and len(by_path) == 9
    assert by_path[str(tmp_path / "gone")].size is None


def test_duplicate_files(spark, rows, trees):
    dupes, bad = files.duplicate_files(files.scan_inventory(spark, [str(trees / "recursive")]))
    assert bad.count() == 0
    assert sorted(r["count"] for r in dupes.groupBy("hash").count().collect()) == [31, 31]
    none, _ = files.duplicate_files(files.scan_inventory(spark, [str(trees / "flat")]), short=True)
    assert none.count() == 0


def test_unreadable_files_are_put_aside(spark, trees):
    good = str(trees / "flat" / "file0.txt")
    listing = spark.createDataFrame([(8, good), (8, "/no/such/file"), (8, str(trees))], "size bigint, path string")
    ok, bad = inventory.split_errors(files.hash_files(listing))
    assert [(r.path, len(r.hash)) for r in ok.collect()] == [(good, 40)]
    assert sorted(r.error for r in bad.collect()) == [f"EISDIR: {trees}", "ENOENT: /no/such/file"]


def test_scan_objects(spark, trees):
    found = files.scan_objects(spark, [str(trees / "flat"), str(trees / "recursive")])
    assert found.count() == 66
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


@pytest.mark.parametrize("subtrees, loose, names", [(64, 20, 250_000), (8, 3, 5), (1, 3, 5)])
def test_objects_are_indexed_some_folders_at_a_time(spark, tmp_path, monkeypatch, subtrees, loose, names):
    """The rows are those of Spark's reader over the whole tree; patterns in names, links, hidden names, overlapping roots."""
    for name in ("a/x=[1]*/{b}?/f %20.txt", "a/x=[1]*/\\g", "a/_h/f", "a/.h", "_k=v/f", "b/n,o/f\ng", "b/_metadata/f"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    grow(str(tmp_path / "t/many"), 2, 2, 5)
    (tmp_path / "t/empty").mkdir()
    os.symlink("../a", tmp_path / "t/b/link")
    os.symlink("gone", tmp_path / "t/b/lost")
    for setting, value in (("SUBTREES", subtrees), ("LOOSE_FILES", loose), ("INDEX_NAMES", names)):
        monkeypatch.setattr(files, setting, value)
    root = str(tmp_path / "t")
    for roots in ([root], [root, f"file://{root}/a"], [f"{root}/{{b,b/*,a/_h}}"], [f"{root}/a/_h/f"], [f"{root}/empty"]):
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        want = sorted((r.path, r.length) for r in whole.select("path", "length").collect())
        assert sorted((r.path, r.size) for r in files.scan_objects(spark, roots).collect()) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_objects(spark, [root, f"{root}/gone"])


def test_objects_are_looked_at_many_to_a_task(spark, tmp_path):
    """A task gets files by their number, not 32 of them; the session's own settings stay."""
    grow(str(tmp_path / "t"), 1, 3, 300)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.sparkContext.setJobGroup("scan", "scan_objects")
    try:
        found = files.scan_objects(spark, [str(tmp_path / "t")])
        assert found.count() == 1200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("scan") for s in tracker.getJobInfo(j).stageIds}
    assert max(i.numTasks for i in map(tracker.getStageInfo, stages) if i) <= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_size_listing(spark, rows, tmp_path):
    (tmp_path / "s.txt").write_bytes(b"5 /a/x y.txt\n5 /a/Icon\r\n0 /a/last")
    path = str(tmp_path / "s.txt")
    assert rows(listings.read_size_listing(spark, path)) == [(0, "/a/last"), (5, "/a/Icon"), (5, "/a/x y.txt")]


def test_bad_listing_lines(spark, rows, tmp_path):
    (tmp_path / "s.txt").write_text("5 /a\nabc\n")
    with pytest.raises(Exception, match="not a listing line: abc"):
        listings.read_size_listing(spark, str(tmp_path / "s.txt")).count()
    good, bad = inventory.split_errors(listings.read_size_listing(spark, str(tmp_path / "s.txt"), "quarantine"))
    assert rows(good) == [(5, "/a")] and rows(bad, "error") == [("abc",)]


def test_hash_listing(spark, rows, tmp_path):
    (tmp_path / "h.txt").write_text("0beec7b5ea 3 /a/f\n")
    got = listings.read_hash_listing(spark, str(tmp_path / "h.txt"))
    assert rows(got) == [("0beec7b5ea", 3, "/a/f")]
    listings.write_hash_listing(got, str(tmp_path / "out"))
    assert rows(listings.read_hash_listing(spark, str(tmp_path / "out"))) == rows(got)


def test_words(spark, rows, tmp_path):
    (tmp_path / "w.txt").write_text("one\n\n  two \t\nthree\r\n   \n")
    assert rows(listings.read_lines(spark, str(tmp_path / "w.txt"))) == [("one",), ("three",), ("two",)]


def test_word_counts(spark, rows, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("the 1\nof 2\nand 3\n42 9\n!! x\nof 5\r\nof 4\n")
    assert rows(listings.read_word_counts(spark, str(path))) == [("and", 3.0), ("of", 4.0), ("the", 1.0)]
    path.write_text("the 1 2\n")
    with pytest.raises(Exception, match="not a word and a count"):
        listings.read_word_counts(spark, str(path)).count()
    path.write_text("the one\n")
    with pytest.raises(Exception, match="count is not a number"):
        listings.read_word_counts(spark, str(path)).count()


def test_uris_are_walked_and_hashed(spark, rows, tmp_path):
    """Names that Spark's sources hide, blanks and percent signs; links are listed and not followed."""
    grow(str(tmp_path / "t"), 1, 1, 2)
    (tmp_path / "t" / ".hidden").mkdir()
    for name in (".hidden/_x y%20#?.txt", "_a", ".b"):
        (tmp_path / "t" / name).write_text("same content")
    os.symlink(tmp_path / "t", tmp_path / "t" / "loop")
    plain = rows(files.scan_inventory(spark, [str(tmp_path / "t")]).filter("not is_dir and not is_symlink"), "path", "size")
    found = files.scan_inventory(spark, [f"file://{tmp_path}/t", f"file://{tmp_path}/gone"])
    assert [(f"file://{p}", s) for p, s in plain] == rows(found.filter("not is_dir and not is_symlink and size is not null"), "path", "size")
    assert [r.path for r in found.filter("is_symlink").collect()] == [f"file://{tmp_path}/t/loop"]
    assert [r.path for r in found.filter("size is null").collect()] == [f"file://{tmp_path}/gone"]
    dupes, bad = files.duplicate_files(found)
    assert sorted(os.path.basename(r.path) for r in dupes.filter("size = 12").collect()) == [".b", "_a", "_x y%20#?.txt"]
    assert [r.path for r in bad.collect()] == [f"file://{tmp_path}/gone"]


def test_uris_of_one_slash_and_their_errors(spark, tmp_path):
    (tmp_path / "f").write_text("abc")
    listing = spark.createDataFrame([(3, f"file:{tmp_path}/f"), (0, f"file://{tmp_path}"), (1, f"file://{tmp_path}/no")], "size long, path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.hash_files(listing).collect()}
    assert got["f"].hash == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert got["no"].error.startswith("ENOENT: ") and got[tmp_path.name].error.startswith("EISDIR: ")


def test_files_are_spread_by_size(spark):
    """Two huge files never share a task, many small ones do."""
    listing = [(1000, f"/big{i}") for i in range(4)] + [(10, f"/small{i}") for i in range(40)]
    table = spark.createDataFrame(listing, "size long, path string")
    tasks = files.hash_files(table, task_bytes=1000).select("path", F.spark_partition_id().alias("p")).collect()
    big = [r.p for r in tasks if r.path.startswith("/big")]
    assert len(set(big)) == 4 and len({r.p for r in tasks}) <= 6 and len(tasks) == 44


def test_documents_as_files(spark, tmp_path, monkeypatch):
    """Tasks write folders of bounded size themselves: no checksum file of a writer of Spark's stands next to a document."""
    monkeypatch.setattr(queries, "FOLDER_FILES", 3)
    texts = [(f"text {i}", "en") for i in range(7)] + [(None, "de"), ("x", None), ("", "e:n"), ("y", "")]
    spark.createDataFrame(texts, "text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    root = queries._document_files(spark, str(tmp_path))
    held = {d: names for d, _, names in os.walk(root) if names}
    assert max(map(len, held.values())) <= 3 and sum(map(len, held.values())) == len(texts)
    assert {os.path.basename(d) for d in held} == {"lang=en", "lang=de", "lang=e%3An", "lang=__HIVE_DEFAULT_PARTITION__"}
    want = sorted((t or "") + "\n" for t, _ in texts)
    assert sorted(open(os.path.join(d, n)).read() for d, names in held.items() for n in names) == want


def test_local_folders_are_listed_name_by_name(tmp_path, monkeypatch):
    """By URI too: no whole list is asked for. Links to nowhere are left out, other links have no size."""
    grow(str(tmp_path / "t"), 1, 1, 2)
    for name, to in (("link", "file0.txt"), ("lost", "gone"), ("loop", "loop"), ("up", "..")):
        os.symlink(to, tmp_path / "t" / name)
    monkeypatch.setattr(stores.fs, "FileSelector", None)
    got = sorted((p.removeprefix(f"file://{tmp_path}/t/"), *r) for p, *r in stores.children(f"file://{tmp_path}/t/"))
    files_, links = [("file0.txt", False, False, 8), ("file1.txt", False, False, 8)], [("link", False, True, 0), ("up", False, True, 0)]
    assert got == sorted([("dir0", True, False, 0), *files_, *links])
    assert list(stores.children(f"file://{tmp_path}/gone")) == []
