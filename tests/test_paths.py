import random

import pytest

from fleetlens.operators import inventory, paths

TREE = [
    ("/r", True),
    ("/r/a", True),
    ("/r/a/node_modules", True),
    ("/r/a/node_modules/p", True),
    ("/r/a/node_modules/p/i.js", False),
    ("/r/a/m.js", False),
]


def entries(spark, tree):
    return spark.createDataFrame(
        [(p, d, False, None if d else 3) for p, d in tree], "path string, is_dir boolean, is_symlink boolean, size bigint"
    )


def listed(df):
    return sorted(r.path for r in df.filter("is_dir").collect()), sorted(r.path for r in df.filter("!is_dir").collect())


def test_exclude(spark):
    dirs, files = listed(inventory.exclude_paths(entries(spark, TREE), ["node_modules"]))
    assert dirs == ["/r", "/r/a", "/r/a/node_modules"] and files == ["/r/a/m.js"]


def test_find(spark):
    dirs, files = listed(inventory.visible(entries(spark, TREE), find_dirs=["node_modules"]))
    assert dirs == ["/r/a/node_modules"] and files == ["/r/a/m.js"]
    assert inventory.outermost_matches(entries(spark, TREE), ["node_modules"]).count() == 1


def test_roots_are_listed(spark):
    tree = [("/xfoo/a", True), ("/xfoo/a/b", True), ("/xfoo/a/f", False)]
    assert listed(inventory.exclude_paths(entries(spark, tree), ["foo"], roots=["/xfoo/a"])) == (["/xfoo/a"], [])
    whole = inventory.exclude_paths(entries(spark, tree), ["foo"], whole_component=True)
    assert listed(whole) == (["/xfoo/a", "/xfoo/a/b"], ["/xfoo/a/f"])


def walk(tree, exclude, find):
    """The rule told over the tree itself: go down from the root, stop where a term says so."""
    children = {}
    for path, is_dir in tree:
        children.setdefault(path.rsplit("/", 1)[0], []).append((path, is_dir))
    out = []

    def visit(path, is_dir):
        bad, good = any(t in path for t in exclude), any(t in path for t in find)
        if not is_dir:
            out.extend([] if bad else [path])
            return
        if good or not find:
            out.append(path)
        if not bad and not good:
            for child in children.get(path, []):
                visit(*child)

    visit("/r", True)
    return sorted(out)


@pytest.mark.parametrize("exclude, find", [(["ab"], []), ([], ["b/a"]), (["c"], ["bb"]), (["a/b", "cc"], ["ca"])])
def test_terms_equal_a_walk(spark, exclude, find):
    rng = random.Random(5)
    tree = {"/r": True}
    for _ in range(400):
        base = rng.choice([p for p, d in tree.items() if d])
        tree.setdefault(base + "/" + "".join(rng.choices("abc", k=rng.randrange(1, 4))), rng.random() < 0.6)
    got = inventory.visible(entries(spark, tree.items()), exclude, find, roots=["/r"])
    assert sorted(r.path for r in got.collect()) == walk(list(tree.items()), exclude, find)


def test_split_and_counts(spark, rows):
    df = spark.createDataFrame(
        [("/r", True, False, None), ("/r/l", False, True, 9), ("/r/f", False, False, None), ("/r/g", False, False, 4)],
        "path string, is_dir boolean, is_symlink boolean, size bigint",
    )
    dirs, files = inventory.split_entries(df)
    assert rows(dirs) == [("/r",)] and rows(files) == [(0, "/r/f"), (4, "/r/g")]
    assert rows(inventory.scan_counts(df)) == [(2, 1)]


def test_nodes(spark, rows):
    files = spark.createDataFrame(
        [(1, "/a/b/x.txt", 5), (2, "/a/c", 7), (3, "/a/c/d", 1), (4, "a//b/y.txt/", 2), (5, "/a/b/x.txt", 9), (6, "/", 3)],
        "id bigint, path string, size bigint",
    )
    nodes = paths.path_nodes(files, "id")
    assert rows(nodes) == [
        ("/a", "/", "a", 1, True, 0),
        ("/a/b", "/a", "b", 2, True, 0),
        ("/a/b/x.txt", "/a/b", "x.txt", 3, False, 5),
        ("/a/b/y.txt", "/a/b", "y.txt", 3, False, 2),
        ("/a/c", "/a", "c", 2, True, 0),
        ("/a/c/d", "/a/c", "d", 3, False, 1),
    ]
    leaves = [("/a/b/x.txt", 5), ("/a/b/y.txt", 2), ("/a/c/d", 1)]
    assert rows(paths.leaf_paths(nodes)) == leaves == rows(paths.childless(nodes))
    shallow = paths.shallowest_files(nodes, cap=1).collect()
    assert [(r.depth, r.path) for r in shallow] == [(3, "/a/b/x.txt"), (3, "/a/b/y.txt")]


def test_extensions(spark, rows):
    files = spark.createDataFrame([("/a/x.js", 1), ("/b/y.js", 2), ("/b/.js", 4), ("/b/z.JS", 8)], "path string, size bigint")
    assert rows(paths.extension_stats(files)) == [("", 1, 4), (".JS", 1, 8), (".js", 2, 3)]
