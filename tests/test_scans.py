"""Discovery of files without their contents, and pages by format."""

import pytest

from sparkrecon.sources import scans


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    nested = root / "notice-evidence"
    nested.mkdir()
    for at, name, content in [
        (root, "a.pdf", b"one\fx"), (root, "ledger.pdf", b"ledger"), (root, "d.doc", b"?"), (root, "p.PNG", b"image"), (root, "bad.pdf", b"\xff\xfe"), (root, "empty.jpg", b"-"), (root, "none.jpg", b""), (root, "~$b.xlsx", b"lock"), (root, "b.xlsx", b"sheet"),
        (nested, "a.pdf", b"hidden"), (nested, "e.pdf", b"nested page"),
    ]:
        (at / name).write_bytes(content)
    return str(root)


def test_first_folder_wins_and_contents_are_not_read(spark, root):
    where = scans.folders(spark, root)
    assert len(where) == 2
    found = scans.listed(spark, where, skip=["ledger.pdf"])
    assert sorted((r["name"], r["folder"]) for r in found.collect()) == [("a.pdf", 0), ("bad.pdf", 0), ("e.pdf", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content:binary" not in plan
    assert found.filter("cache_key like 'a|%|5'").count() == 1
    with pytest.raises(ValueError):
        scans.listed(spark, [])


def test_pages_by_format(spark, root):
    layers = {"pdf": lambda content: content.decode().split("\f")}
    others = {"pdf": lambda content: [f"read {i}" for i in range(2)], "png": lambda content: ["picture"], "jpg": lambda content: []}
    where = scans.folders(spark, root)
    found = scans.scanned(spark, where, layers, others, skip=["ledger.pdf", "b.xlsx"], least=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # contents stay where they are read
    rows = {(r["file"], r["page"]): (r["text"], r["method"], (r["error"] or "").split(":")[0]) for r in found.collect()}
    assert rows == {
        ("a.pdf", 1): ("one", "layer", ""), ("a.pdf", 2): ("read 1", "read", ""), ("e.pdf", 1): ("nested page", "layer", ""),
        ("d.doc", None): (None, None, "unsupported"), ("p.PNG", 1): ("picture", "read", ""), ("bad.pdf", None): (None, None, "UnicodeDecodeError"), ("empty.jpg", None): (None, None, "no pages"),
    }


def test_first_existing_path(spark, root):
    assert scans.first_existing(spark, [f"{root}/none.pdf", f"{root}/a.pdf"]).endswith("b.xlsx")  # a sheet beside the first candidate
    assert scans.first_existing(spark, [f"{root}/nowhere/none.xlsx", f"{root}/a.pdf"]) == f"{root}/a.pdf"
    with pytest.raises(FileNotFoundError):
        scans.first_existing(spark, [f"{root}/nowhere/none.xlsx"])
