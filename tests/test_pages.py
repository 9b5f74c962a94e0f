"""Pages from files: broken ones give stubs, all others stay."""

import hashlib

from docloom.sources import pages


def test_a_folder_with_broken_files(spark, tmp_path):
    contents = {
        "a.txt": "One\npage\fTwo é\f".encode(),
        "sub/b.txt": b"good\f\xff\xfe broken\fgood again \xe4\xb8\xad",
        "empty.txt": b"",
        "large.txt": b"x" * 5000,
        "broken.txt": b"\x80\x81",
        "skipped.bin": b"no",
    }
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = pages.read_pages(spark, str(tmp_path), "*.txt", most_bytes=1000).collect()
    got = {(r.path.rsplit("/", 1)[1], r.page_number): (r.text, r.processing_errors) for r in rows}
    assert got == {
        ("a.txt", 1): ("One\npage", []), ("a.txt", 2): ("Two é", []), ("a.txt", 3): ("", []),
        ("b.txt", 1): ("good", []), ("b.txt", 2): ("", ["not UTF-8"]), ("b.txt", 3): ("good again 中", []),
        ("large.txt", 1): ("", ["too large"]), ("broken.txt", 1): ("", ["not UTF-8"]),
    }
    one = next(r for r in rows if r.path.endswith("b.txt") and r.page_number == 2)
    digest = hashlib.sha256(contents["sub/b.txt"]).hexdigest()
    assert (one.page_id, one.char_count, one.approx_tokens, one.width, one.height, one.orientation) == (f"{digest}:p2", 0, 0, 612, 792, "portrait")


def test_nothing_to_read(spark, tmp_path):
    assert pages.read_pages(spark, str(tmp_path)).count() == 0
    files = spark.createDataFrame([("p", None, None), ("q", None, "denied")], "path string, content binary, error string")
    assert {(r.path, r.processing_errors[0]) for r in pages.page_rows(files).collect()} == {("p", "empty file"), ("q", "denied")}
