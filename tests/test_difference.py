import shutil

from brightloom.operators.difference import difference, write_index


def index(spark, path, rows):
    write_index(spark.createDataFrame([(*r[:3], len(r[3]), r[3]) for r in rows], "root string, node string, path string, length long, sha256 string"), str(path))
    return str(path)


def found(spark, old, new):
    return {(r.root, r.path): (r.change, r.old_sha256, r.new_sha256) for r in difference(spark, old, new).collect()}


def test_added_removed_changed(spark, tmp_path):
    same = [("r", "m", f"same{i}", f"s{i}") for i in range(300)]
    old = index(spark, tmp_path / "old", [*same, ("r", "m", "gone", "x"), ("r", "m", "new text", "a"), ("only old", "m", "f", "1"), ("alike", "m", "f", "1")])
    new = index(spark, tmp_path / "new", [*same, ("r", "m", "come", "y"), ("r", "m", "new text", "b"), ("only new", "m", "f", "1"), ("alike", "m", "f", "1")])
    want = {("r", "gone"): ("removed", "x", None), ("r", "come"): ("added", None, "y"), ("r", "new text"): ("changed", "a", "b"), ("only old", "f"): ("removed", "1", None), ("only new", "f"): ("added", None, "1")}
    assert found(spark, old, new) == want
    assert found(spark, new, new) == {}


def test_only_folders_of_cells_that_differ_are_read(spark, tmp_path):
    same = [("r", "m", f"same{i}", f"s{i}") for i in range(300)]
    old = index(spark, tmp_path / "old", same)
    new = index(spark, tmp_path / "new", [*same, ("r", "m", "come", "y")])
    cell = [r.cell for r in spark.read.parquet(f"{new}/members").filter("path = 'come'").collect()]
    for path in (old, new):  # what stays equal may as well be gone
        for folder in (tmp_path / path / "members").glob("folder=*"):
            if folder.name != f"folder={cell[0][:2]}":
                shutil.rmtree(folder)
    assert found(spark, old, new) == {("r", "come"): ("added", None, "y")}


def test_packages_of_nothing(spark, tmp_path):
    empty, one = index(spark, tmp_path / "a", []), index(spark, tmp_path / "b", [("r", "m", "f", "1")])
    assert found(spark, empty, empty) == {} and found(spark, empty, one) == {("r", "f"): ("added", None, "1")}
