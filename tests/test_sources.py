import pytest
from pyspark.sql import functions as F

from quarry.functions.chunking import page_cuts, recursive_cuts
from quarry.sources import files, objects


def test_bytes_become_text(spark):
    cases = {b"\xef\xbb\xbfa\r\nb\rc": "a\nb\nc", b"caf\xe9": "caf\xe9", "caf\xe9 \u4e2d\U0001f600".encode(): "caf\xe9 \u4e2d\U0001f600", b"": "", b"\xef\xbb\xbf": "", b"\xef\xbb\xbf\xe9": "\xef\xbb\xbf\xe9", b"\r\r\n\n": "\n\n\n", None: None, b"\xc3": "\xc3"}
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary").select("i", files.decoded(F.col("c")).alias("t"))
    assert {r.i: r.t for r in rows.collect()} == dict(enumerate(cases.values()))


def test_files_become_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello\r\nworld")
    (tmp_path / "B.TXT").write_bytes(b"ab\ncd\nefgh")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "empty.txt").write_bytes(b"")
    (tmp_path / "noend").write_bytes(b"x")
    rows = sorted((r.doc_key, r.page_no, r.text, r.tables, r.error) for r in files.read_pages(spark, str(tmp_path), size=7).collect())
    assert rows == [("B.TXT", 1, "ab\ncd\ne", "", None), ("B.TXT", 2, "fgh", "", None), ("a.txt", 1, "hello\nw", "", None), ("a.txt", 2, "orld", "", None), ("c.bin", 0, None, "", "unknown format: bin"), ("noend", 0, None, "", "unknown format: none")]


def test_pages_are_drawn_out_to_line_breaks():
    assert page_cuts("ab\ncd\nefgh", 4, 3) == ["ab\ncd", "efg", "h"]
    assert page_cuts("abcdefgh", 3, 2) == ["abc", "def", "gh"]
    assert page_cuts("  ", 3) == [""]
    assert page_cuts("abcd", 0) == ["abcd"]


def test_recursive_cuts():
    assert recursive_cuts("", 10, 2) == []
    assert recursive_cuts("abcdefghij", 10, 2) == ["abcdefghij"]
    # Every piece gets its separator, whether the text had one or not.
    assert recursive_cuts("abcdefghijk", 10, 0) == ["abcdefghij", "k。！？.؛;"]
    assert recursive_cuts("aa bb\n\ncc dd", 6, 0) == ["aa bb", "cc dd"]
    assert recursive_cuts("aa bb\n\ncc dd", 6, 2) == ["aa bb", "bbcc dd"]
    assert recursive_cuts("第一句。第二句。", 4, 0) == ["第一句。", "第二句。"]
    assert recursive_cuts("   \n ", 2, 1) == []


def test_objects(spark, tmp_path):
    store = objects.ObjectStore(spark, f"{tmp_path}/bucket")
    assert not store.exists("a/x.txt")
    assert store.put("a/x.txt", "caf\xe9") == store.uri("a/x.txt") == f"{tmp_path}/bucket/a/x.txt"
    assert store.get("a/x.txt") == "caf\xe9".encode() and store.exists("a/x.txt")
    rows = spark.createDataFrame([("a/y.bin", b"12"), ("b/z.bin", b""), (None, b"1")], "key string, content binary")
    assert sorted((r.key, r.n_bytes) for r in store.put_all(rows).collect()) == [("a/y.bin", 2), ("b/z.bin", 0)]
    assert store.get("a/y.bin") == b"12"
    assert store.clear("a") and not store.clear("a") and store.exists("b/z.bin")
    with pytest.raises(KeyError):
        store.get("a/x.txt")
    for bad in (lambda: store.clear("/"), lambda: store.uri("../x")):
        with pytest.raises(ValueError):
            bad()
