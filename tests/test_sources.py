import gzip
import io
import tarfile
import tracemalloc

from pyspark.sql import functions as F

from riskloom.operators import lines
from riskloom.sources import images, trees


def test_tree_is_read_with_hidden_files(spark, tmp_path):
    for name, data in {"a.py": b"eval(x)\n", ".github/workflows/ci.yml": b"on: pull_request_target", "node_modules/x.js": b"eval(x)", "b.bin": b"a\0b", "empty.py": b"", "gen/out.min.js": b"eval(x)", "src/generated/z.py": b"eval(x)", "my-testdata-notes.js": b"eval(x)"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    files = trees.source_files(spark, f"file://{tmp_path}", ["*.min.js", "src/generated", "testdata"])
    assert {r["path"] for r in files.collect()} == {"a.py", ".github/workflows/ci.yml", "my-testdata-notes.js"}
    rows = trees.source_lines(files)
    assert rows.where("path = 'a.py'").count() == 2
    assert {(r["path"], r["rule"]) for r in lines.code_findings(rows).collect()} == {("a.py", "py-eval-exec"), ("my-testdata-notes.js", "js-eval")}
    assert {r["rule"] for r in lines.config_findings(rows).collect()} == {"gha-pull-request-target"}


def test_policy_and_custom_rules(spark):
    p = trees.parse_policy("fail-on: high\ndisable: [a, 'b']\nignore:\n  - vendor\n  - \"x y\"\n")
    assert (p.fail_on, p.disable, p.ignore) == ("high", ["a", "b"], ["vendor", "x y"])
    rules = trees.parse_rules("rules:\n - id: no-foo\n   pattern: 'foo\\('\n   langs: [py]\n   severity: high\n - id: bad\n   pattern: '('\n - pattern: x\n")
    assert rules == [("custom:no-foo", "HIGH", "", "py", "foo\\(")]
    frame = spark.createDataFrame([("a.py", 1, "foo(1)"), ("a.js", 1, "foo(1)")], "path string, line_no int, line string")
    assert [(r["path"], r["rule"]) for r in lines.code_findings(frame, rules).collect()] == [("a.py", "custom:no-foo")]


def test_ignore_patterns(spark):
    cases = {"testdata/a": True, "x/testdata/b.go": True, "a.min.js": True, "my-testdata-notes.js": False, "src/generated/q": True, "src/gen": False}
    frame = spark.createDataFrame([(c,) for c in cases], "p string")
    made = dict(frame.select("p", trees.ignored(F.col("p"), ["testdata", "*.min.js", "src/generated"])).collect())
    assert made == cases


def test_ignore_file_and_links(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("eval(x)")
    (tmp_path / "a" / "y.py").write_bytes(b"\xff\xfe eval")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / ".ignore-these").write_text("# no\n\n  gone/ \n*.md\n")
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone" / "z.py").write_text("eval(x)")
    (tmp_path / "large.py").write_bytes(b"x" * (trees.LARGEST + 1))
    patterns = trees.read_ignore(f"file://{tmp_path}", ".ignore-these")
    assert patterns == ["gone", "*.md"] and trees.read_ignore(str(tmp_path), "none") == []
    made = {r["path"]: r["content"] for r in trees.source_files(spark, f"file://{tmp_path}", patterns).collect()}
    assert set(made) == {"a/x.py", "a/y.py", ".ignore-these"} and made["a/y.py"] == "�� eval"
    assert trees.source_files(spark, f"file://{tmp_path}/missing").count() == 0


def _tar(entries, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as made:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "elsewhere"
            else:
                info.size = len(data)
            made.addfile(info, io.BytesIO(data) if data is not None else None)
    return out.getvalue()


def test_saved_images(spark, tmp_path):
    def dpkg(*packages):
        return "\n\n".join(f"Package: {p}\nStatus: install ok installed\nVersion: {v}" for p, v in packages).encode()

    system = b'NAME=x\nID=debian\nVERSION_ID="12"\n'
    first = _tar([("./var/lib/dpkg/status", dpkg(("old", "1"))), ("/etc/os-release", system), ("usr/big", b"x" * 3_000_000)])
    second = _tar([("var/lib/dpkg/status", dpkg(("lib", "1"), ("two", "2"))), ("var/lib/dpkg/.wh.status", b"")], "w:gz")
    images_ = {
        "a.tar": _tar([("m.json", b"[]"), ("1/layer.tar", first), ("2/layer.tar", second), ("repositories", b"{}")]),
        "b.tar": _tar([("1", gzip.compress(_tar([("lib/apk/db/installed", b"P:musl\nV:1.2\n\nP:none\n\nP:busybox\nV:3")]))), ("2", _tar([("etc/alpine-release", b"3.12.1\n")]))]),
        "c.tar": _tar([("1/layer.tar", first), ("2/layer.tar", _tar([("var/lib/dpkg/status", None)]))]),  # a link counts as an empty database
        "d.tar": _tar([("1/layer.tar", first[:700]), ("2/layer.tar", second[: len(second) // 2]), ("3/layer.tar", _tar([("var/lib/dpkg/status", dpkg(("late", "9")))]))]),
        "e.tar": b"no archive", "f.tar": b"",
    }
    for name, data in images_.items():
        (tmp_path / name).write_bytes(data)
    uris = [f"file://{tmp_path}/{name}" for name in images_]
    table = images.image_files_of(spark.createDataFrame([(u,) for u in uris] + [(None,)], "image string"))
    source = images.image_files(spark, uris)
    assert {tuple(r) for r in table.collect()} == {tuple(r) for r in source.collect()}
    made = {(r["image"][-5:], r["name"], r["version"], r["ecosystem"]) for r in images.installed(source).collect()}
    assert made == {("a.tar", "lib", "1", "Debian:12"), ("a.tar", "two", "2", "Debian:12"), ("b.tar", "musl", "1.2", "Alpine:v3.12"), ("b.tar", "busybox", "3", "Alpine:v3.12"), ("d.tar", "late", "9", "Debian")}


def test_layers_are_streams():
    """A layer of 64 MB of zeros, packed, is never held whole."""
    big = tarfile.TarInfo("usr/zeros")
    big.size = 64 << 20

    class Zeros:
        def read(self, n):
            return b"\0" * n

    layer = io.BytesIO()
    with tarfile.open(fileobj=layer, mode="w:gz") as made:
        made.addfile(big, Zeros())
        info = tarfile.TarInfo("lib/apk/db/installed")
        info.size = 8
        made.addfile(info, io.BytesIO(b"P:a\nV:1\n"))
    data = _tar([("l.tar", layer.getvalue())])
    tracemalloc.start()
    assert [r[2:] for r in images.databases(io.BytesIO(data))] == [(images.APK, "P:a\nV:1\n")]
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
