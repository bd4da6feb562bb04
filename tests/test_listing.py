"""Folder trees listed by tasks."""

import os

from trapgrid.sources import listing, readers


def walked(spark, root):
    return sorted((r.path, r.length) for r in listing.walk_files(spark, root).collect())


def test_walk_equals_a_plain_walk(spark, tmp_path):
    root = tmp_path / "photos store"
    for i in range(40):
        folder = root / f"cam {i % 7}" / ("a%20b" if i % 2 else "déjà") / ("x" * (i % 3 + 1))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"IMG_{i}.jpg").write_bytes(b"x" * i)
    (root / "top.csv").write_text("1")
    (root / "empty" / "deep" / "deeper").mkdir(parents=True)
    want = sorted((os.path.relpath(os.path.join(d, f), root), os.path.getsize(os.path.join(d, f))) for d, _, fs in os.walk(root) for f in fs)
    assert walked(spark, str(root)) == want and len(want) == 41
    assert walked(spark, root.as_uri()) == want and walked(spark, str(root) + "/") == want
    assert sorted(tuple(r) for r in readers.list_files(spark, str(root)).collect()) == [x for x in want if x[1]]


def test_links_and_empty_trees(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert walked(spark, str(tmp_path)) == []
    (tmp_path / "a" / "f").write_text("123")
    (tmp_path / "a" / "again").symlink_to(tmp_path)  # would go round for ever
    (tmp_path / "a" / "dead").symlink_to(tmp_path / "nothing")
    (tmp_path / "a" / "live").symlink_to(tmp_path / "a" / "f")
    assert walked(spark, str(tmp_path)) == [("a/dead", None), ("a/f", 3), ("a/live", 3)]


def test_many_files_in_one_folder(spark, tmp_path, monkeypatch):
    for i in range(listing._ENTRIES + 5):
        (tmp_path / str(i)).touch()
    assert listing.walk_files(spark, str(tmp_path)).count() == listing._ENTRIES + 5
