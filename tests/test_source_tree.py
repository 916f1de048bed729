"""The source tree reader: heads first, planned by size."""

import pytest

from opslens.sources import files, readers


@pytest.fixture
def tree(tmp_path):
    def put(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    put("src/a.cpp", b"int a;\n")
    put("src/B.HPP", "ä\n".encode() + b"\xff\xfe x\n")
    put("src/late.cc", b"x" * 9000 + b"\0y")  # a NUL behind the head is text
    put("src/blob.h", b"a\0b")
    put("src/empty.c", b"")
    put("src/.h", b"hidden")
    put("vendor/v.cpp", b"foreign")
    put("src/build/gen.cpp", b"foreign")
    put("build.cpp", b"a file may be named like a folder")
    put("notes.txt", b"other")
    put("CMakeLists.TXT", b"set(A)")
    put("x/rules.MK", b"-Wall")
    with open(tmp_path / "src/huge.cpp", "wb") as file:  # sparse: 3 GB with a NUL in its head
        file.truncate(3 << 30)
    return tmp_path


def read(df):
    return {r.path: r.text for r in df.collect()}


def test_reads_sources(spark, tree):
    got = read(readers.read_corpus(spark, str(tree)))
    assert got == {
        "src/a.cpp": "int a;\n", "src/B.HPP": "ä\n�� x\n", "src/late.cc": "x" * 9000 + "\0y", "src/empty.c": "",
        "build.cpp": "a file may be named like a folder",
    }
    every = read(readers.read_corpus(spark, f"file://{tree}/", include_all=True))
    assert set(every) - set(got) == {"vendor/v.cpp", "src/build/gen.cpp"}
    assert set(read(readers.read_build_files(spark, str(tree)))) == {"CMakeLists.TXT", "x/rules.MK"}


def test_partitions_follow_listed_bytes(spark, tree):
    df = readers.read_corpus(spark, str(tree), partBytes=100)
    assert df.rdd.getNumPartitions() == 3  # the large files stand alone
    assert len(read(df)) == 5
    reader = files.TreeReader({"root": f"file://{tree}", "names": r"[^/]\.cpp\Z", "partBytes": "1"})
    assert all(len(p.files) == 1 for p in reader.partitions())


def test_a_text_too_long_for_a_row(spark, tree):
    with pytest.raises(Exception, match="late.cc is a text of 9002 bytes"):
        read(readers.read_corpus(spark, str(tree), mostBytes=5000))
    (tree / "src/late.cc").write_bytes(b"\0" + b"x" * 9000)  # a binary of that size fails nothing
    assert "src/late.cc" not in read(readers.read_corpus(spark, str(tree), mostBytes=5000))


def test_no_files(spark, tmp_path):
    assert read(readers.read_corpus(spark, str(tmp_path))) == {}
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        read(readers.read_corpus(spark, str(tmp_path / "nowhere")))


def test_stores_that_only_spark_reads(spark, tree, monkeypatch):
    (tree / "src/huge.cpp").write_bytes(b"\0")
    want = read(readers.read_corpus(spark, str(tree)))
    assert want.pop("src/empty.c") == ""  # Spark's own reader passes over files without bytes
    builds = read(readers.read_build_files(spark, str(tree)))
    monkeypatch.setattr(files, "can_open", lambda root: False)
    assert read(readers.read_corpus(spark, str(tree))) == want
    assert read(readers.read_build_files(spark, str(tree))) == builds
