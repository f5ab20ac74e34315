"""The scan of trees of files against a plain walk."""

import os

import pytest

from corpusloom.sources import trees


def walk(root):
    """Every file by every path, links followed but for those into a directory above."""
    out = {}

    def go(at, rel):
        for name in os.listdir(at):
            path, own = os.path.join(at, name), f"{rel}{name}"
            if os.path.isdir(path):
                real = os.path.realpath(path)
                if not (os.path.islink(path) and (os.path.realpath(at) + "/").startswith(real + "/")):
                    go(path, own + "/")
            elif os.path.isfile(path):
                out[own] = open(path, "rb").read().decode("utf-8", "replace")

    go(root, "")
    return out


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a b#c"
    for path, text in {".hidden/x.txt": b"h", "_tmp/.y": b"u", "src/.git/config": b"g", "src/deep/er/z.c": "é\n".encode(), "empty.txt": b"", "bad.bin": b"a\xffb", "src/%41.txt": b"pct"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text)
    (root / "none").mkdir()
    os.symlink(root / "src", root / "src" / "deep" / "loop")
    os.symlink(root / "src" / "deep", root / "linked")
    os.symlink(root / "bad.bin", root / "file.link")
    os.symlink(root / "missing", root / "dangling")
    return str(root)


@pytest.mark.parametrize("enough", [1, 3, 256])
def test_hidden_files_links_and_loops(spark, tree, monkeypatch, enough):
    monkeypatch.setattr(trees, "ENOUGH", enough)
    got = {r.rel_path: (r.text, r.length) for r in trees.scan_tree(spark, tree).collect()}
    want = walk(tree)
    assert {k: v[0] for k, v in got.items()} == want and ".hidden/x.txt" in got and "linked/er/z.c" in got and not any("loop/" in k for k in got)
    assert got["bad.bin"][1] == 3 and got["src/%41.txt"][0] == "pct"
    assert trees.scan_tree(spark, tree, content=False).where("text is null").count() == len(want)


def test_a_tree_written_is_read_again(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([("a/.b/1.txt", "one\n"), ("2", ""), (None, "x"), ("n", None)], "rel_path string, text string")
    assert sorted(r.rel_path for r in trees.write_tree(rows, root).collect()) == ["2", "a/.b/1.txt"]
    assert {r.rel_path: r.text for r in trees.scan_tree(spark, root).collect()} == {"a/.b/1.txt": "one\n", "2": ""}
    assert trees.scan_tree(spark, str(tmp_path / "nothing")).count() == 0
