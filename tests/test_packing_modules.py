import hashlib
import tarfile

import pytest

from brightloom.operators.bundle import bundle, manifest
from brightloom.operators.closure import closure
from brightloom.operators.pack import pack
from brightloom.sources.module_tree import sources


def reached(spark, roots, edges):
    out = closure(spark.createDataFrame([(r,) for r in roots], "root string"), spark.createDataFrame(edges, "src string, dst string"))
    return {(r.root, r.node): r.depth for r in out.collect()}


def test_diamond_counts_once(spark):
    assert reached(spark, ["a"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y")]) == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2}


def test_cycles_end(spark):
    got = reached(spark, ["a", "c"], [("a", "b"), ("b", "a"), ("b", "b"), ("c", "a")])
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("c", "c"): 0, ("c", "a"): 1, ("c", "b"): 2}


@pytest.mark.parametrize("tables", [1, 8])
def test_deep_and_tangled_graphs(spark, monkeypatch, tables):
    from brightloom.operators import closure as module

    monkeypatch.setattr(module, "TABLES", tables)
    edges = [(f"n{i}", f"n{j}") for i in range(13) for j in {i + 1, (i * 7 + 3) % 11, i // 2}]
    want = {}
    for root in ("n0", "n5", "n13"):
        depth, level = {root: 0}, {root}
        while level:
            level = {d for s, d in edges if s in level} - depth.keys()
            depth |= dict.fromkeys(level, max(depth.values()) + 1)
        want |= {(root, n): d for n, d in depth.items()}
    assert reached(spark, ["n0", "n5", "n13"], edges) == want


def test_nulls_repeats_and_no_edges(spark):
    assert reached(spark, ["a", None, "a"], [("a", None), (None, "b"), ("a", "b"), ("a", "b")]) == {("a", "a"): 0, ("a", "b"): 1}
    assert reached(spark, ["a"], []) == {("a", "a"): 0}
    assert reached(spark, [], [("a", "b")]) == {}


def test_bundle_does_not_depend_on_order_but_on_content(spark):
    r = spark.createDataFrame([("a", "a"), ("a", "b")], "root string, node string")
    files = [("a", "a/1", bytearray(b"x")), ("b", "b/1", None), ("c", "c/1", bytearray(b"z"))]
    one = bundle(r, spark.createDataFrame(files, "node string, path string, content binary")).first()
    two = bundle(r, spark.createDataFrame(files[::-1], "node string, path string, content binary").repartition(3)).first()
    assert one == two and (one.n_files, one.n_bytes) == (2, 1)
    other = [*files[:1], ("b", "b/1", bytearray(b"y"))]
    assert bundle(r, spark.createDataFrame(other, "node string, path string, content binary")).first().digest != one.digest
    rows = manifest(r, spark.createDataFrame(files, "node string, path string, content binary")).collect()
    assert {(x.path, x.sha256) for x in rows} == {("a/1", hashlib.sha256(b"x").hexdigest()), ("b/1", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('module "a" {\n  source = "./x"\n}', ["./x"]),
        ('# module "a" { source = "./no" }\nmodule "a" { source = "../y" // "z"\n version = "1" }', ["../y"]),
        ('resource "r" "n" { source = "./no" }\nmodule "m" {\n providers = { source = "no" }\n source = "git::https://h/r"\n}', ["git::https://h/r"]),
        ('locals { t = <<EOT\nmodule "q" { source = "./no" }\nEOT\n}\n', []),
        ("", []),
    ],
)
def test_sources(text, found):
    assert sources(text) == found


def test_pack_writes_all_that_a_module_reaches(spark, tmp_path):
    tree = tmp_path / "tree"
    for path, text in {
        "main.tf": 'module "a" { source = "./mods/a" }\nmodule "r" { source = "hashes/consul" }',
        "mods/a/main.tf": 'module "b" { source = "../b" }',
        "mods/b/main.tf": 'module "a" { source = "../a" }\nmodule "gone" { source = "../gone" }',
        "mods/b/data/big.txt": "data",
        "mods/c/main.tf": "",
        ".cache/x/main.tf": "",
    }.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    found = pack(spark, str(tree), ".", str(tmp_path / "one.tar"))
    assert found["missing"] == ["hashes/consul", "mods/gone"] and found["files"] == 4
    with tarfile.open(tmp_path / "one.tar") as t:
        assert t.getnames() == ["main.tf", "mods/a/main.tf", "mods/b/data/big.txt", "mods/b/main.tf"]
        assert t.extractfile("mods/a/main.tf").read() == b'module "b" { source = "../b" }'
    assert pack(spark, str(tree), ".", str(tmp_path / "two.tar"))["digest"] == found["digest"]
    assert (tmp_path / "one.tar").read_bytes() == (tmp_path / "two.tar").read_bytes()


@pytest.mark.parametrize("chunk", [1, 700, 64 << 20])
def test_parts_joined_are_the_archive(spark, tmp_path, monkeypatch, chunk):
    import random
    from io import BytesIO

    from brightloom.operators import pack as module

    monkeypatch.setattr(module, "CHUNK_BYTES", chunk)
    rnd = random.Random(chunk)
    contents = {f"d{i % 4}/{'long' * (i * 3)}é{i}" if i % 3 else f"f{i:02}": rnd.randbytes(rnd.choice([0, 1, 511, 512, 513, 1024, 5000])) for i in range(40)}
    contents["zeros"] = bytes(2048)
    files = spark.createDataFrame([(p, bytearray(c) or None) for p, c in contents.items()], "path string, content binary").repartition(5)
    listed = spark.createDataFrame([("r", p, len(c)) for p, c in contents.items()], "root string, path string, length long")
    want = BytesIO()
    with tarfile.open(fileobj=want, mode="w", format=tarfile.PAX_FORMAT) as t:
        for path in sorted(contents, key=str.encode):
            info = tarfile.TarInfo(path)
            info.size = len(contents[path])
            t.addfile(info, BytesIO(contents[path]))
    module.write_parts(listed, files, str(tmp_path / "parts"))
    parts = len(list((tmp_path / "parts").glob("chunk=*")))
    assert parts > 1 if chunk < 1000 else parts == 1
    assert module.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "out.tar"))
    assert (tmp_path / "out.tar").read_bytes() == want.getvalue() and not (tmp_path / "parts").exists()


def test_archive_of_nothing(spark, tmp_path):
    from brightloom.operators.pack import join_parts, write_parts

    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    write_parts(spark.createDataFrame([], "root string, path string, length long"), files, str(tmp_path / "p"))
    assert join_parts(spark, str(tmp_path / "p"), str(tmp_path / "o.tar"))
    with tarfile.open(tmp_path / "o.tar") as t:
        assert t.getnames() == [] and (tmp_path / "o.tar").stat().st_size == tarfile.RECORDSIZE


def test_parts_stay_where_the_store_cannot_join(spark, tmp_path):
    """A file system that neither is local nor joins blocks: a view of a local folder."""
    from brightloom.operators.pack import join_parts, write_parts

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.packs.link./at", f"file://{tmp_path}")
    files = spark.createDataFrame([("a", bytearray(b"x" * 900)), ("b", bytearray(b"y"))], "path string, content binary")
    listed = spark.createDataFrame([("r", "a", 900), ("r", "b", 1)], "root string, path string, length long")
    import brightloom.operators.pack as module

    size, module.CHUNK_BYTES = module.CHUNK_BYTES, 512
    try:
        write_parts(listed, files, "viewfs://packs/at/p")
    finally:
        module.CHUNK_BYTES = size
    assert not join_parts(spark, "viewfs://packs/at/p", "viewfs://packs/at/o.tar")
    assert len(list((tmp_path / "p").glob("chunk=*/part-*"))) > 1


def test_members_stand_where_the_archive_has_them(spark, tmp_path):
    from brightloom.operators.pack import members, resolve

    tree = tmp_path / "tree"
    tree.mkdir()
    for i in range(40):
        path = tree / f"{'d' * (i * 3)}é{i}.txt" if i % 2 else tree / f"f{i}.txt"
        path.write_text("x" * i * 100)
    (tree / "main.tf").write_text("")
    (tree / ("long" * 20) / "and").mkdir(parents=True)
    (tree / ("long" * 20) / "and" / ("more" * 20)).write_text("y" * 512)
    found = pack(spark, str(tree), ".", str(tmp_path / "one.tar"))
    reached_, files, _ = resolve(spark, str(tree), ["."])
    got = {r.path: (r.offset, r.length) for r in members(manifest(reached_, files).select("root", "path", "length")).collect()}
    with tarfile.open(tmp_path / "one.tar") as t:
        want = {m.name: (m.offset, m.size) for m in t.getmembers()}
    assert got == want and found["files"] == len(want) == 42


def test_many_empty_files(spark, tmp_path, monkeypatch):
    from brightloom.sources import module_tree

    monkeypatch.setattr(module_tree, "EMPTY_FILES", 3)
    for i in range(8):
        (tmp_path / f"e{i}.tf").write_text("")
    (tmp_path / "full.txt").write_text("x")
    got = {r.path: bytes(r.content) for r in module_tree.files(spark, str(tmp_path)).collect()}
    assert got == {f"e{i}.tf": b"" for i in range(8)} | {"full.txt": b"x"}


def test_digest_tells_fields_apart(spark):
    def digest(path, content):
        files = spark.createDataFrame([("a", path, bytearray(content))], "node string, path string, content binary")
        return bundle(spark.createDataFrame([("a", "a")], "root string, node string"), files).first().digest

    assert len({digest("x", b"y"), digest("xy", b""), digest("x\ny", b""), digest("", b"xy")}) == 4


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from brightloom.session import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://h:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_command_line(spark, tmp_path, capsys):
    from brightloom.__main__ import main

    (tmp_path / "t" / "m").mkdir(parents=True)
    (tmp_path / "t" / "main.tf").write_text('module "m" { source = "./m" }')
    (tmp_path / "t" / "m" / "x.tf").write_text("")
    assert main(["pack", str(tmp_path / "t"), ".", str(tmp_path / "o.tar")]) == 0
    assert '"files": 2' in capsys.readouterr().out
    (tmp_path / "t" / "m" / "x.tf").write_text('module "n" { source = "../n" }')
    assert main(["pack", str(tmp_path / "t"), ".", str(tmp_path / "o.tar")]) == 1


def test_roots_travel_together(spark, monkeypatch):
    """More roots than a mask has bits; an edge is followed once for all of them."""
    from brightloom.operators import closure as module

    met, plain = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: met.append(plain(df)) or met[-1])
    rows = [(r, "hub") for r in range(130)]
    edges = spark.createDataFrame([(str(r), n) for r, n in rows] + [("hub", "a"), ("a", "hub"), ("a", "b"), ("hub", "a"), ("b", None)], "src string, dst string")
    roots = spark.createDataFrame([(str(r),) for r in range(130)] + [("5",), (None,)], "root string")
    got = sorted(tuple(r) for r in module.closure(roots, edges).collect())
    assert got == sorted((str(r), n, d) for r in range(130) for n, d in ((str(r), 0), ("hub", 1), ("a", 2), ("b", 3)))
    assert [x.count() for x in met if "depth" in x.columns] == [130, 3, 3, 3, 0]
