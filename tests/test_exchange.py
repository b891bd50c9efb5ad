"""Trees, dumps and recovery: hand-written cases and round trips."""
import os

import pytest
from pyspark.sql import functions as F

from filestrata.functions import fixed
from filestrata.sources import dumps, recovery, tree


@pytest.fixture
def folder(tmp_path):
    files = {"pkg/__init__.py": b"import os\n", "_priv/d.py": b"a\xffb\r\nc\rd", ".env": b"x", ".git/x": b"x",
             "Thumbs.db": b"x", "blank.txt": b" \n ", "Makefile": b"all: x y", "img.png": b"\x89PNG",
             "a/b/c/deep.md": b"# t", "a/__pycache__/x.pyc": b"x"}
    for name, data in files.items():
        target = tmp_path / "proj" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(tmp_path / "proj" / "Makefile", tmp_path / "proj" / "link.txt")
    os.symlink(tmp_path / "proj" / "a", tmp_path / "proj" / "loop")
    return tmp_path / "proj"


@pytest.mark.parametrize("splits", ["1", "3", "256"])
def test_tree_scan(spark, folder, splits):
    rows = {r["path"]: r for r in tree.read_tree(spark, path=str(folder), bytes="true", splits=splits).collect()}
    assert set(rows) == {"pkg/__init__.py", "_priv/d.py", "blank.txt", "Makefile", "img.png", "a/b/c/deep.md"}
    assert rows["_priv/d.py"]["content"] == "ab\nc\nd" and rows["_priv/d.py"]["lines"] == 3
    assert bytes(rows["_priv/d.py"]["content_bytes"]) == b"a\xffb\r\nc\rd"
    assert (rows["blank.txt"]["content"], rows["blank.txt"]["lines"]) == ("", 0)
    assert (rows["img.png"]["content"], rows["img.png"]["read_status"]) == (None, "not_text")
    assert rows["Makefile"]["words"] == 3 and rows["Makefile"]["project_id"] == "proj"


def test_tree_size_tiers(spark, tmp_path):
    with open(tmp_path / "large.txt", "wb") as f:
        f.truncate(fixed.READ_LIMIT + 1)
    with open(tmp_path / "giant.txt", "wb") as f:
        f.truncate(fixed.DROP_ABOVE + 1)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "x.py").write_text("1")
    roots = f"one={tmp_path},two={tmp_path / 'two'}"
    limits = {"read_limit": str(fixed.READ_LIMIT), "drop_above": str(fixed.DROP_ABOVE)}
    rows = {(r["project_id"], r["path"]): r for r in tree.read_tree(spark, roots=roots, **limits).collect()}
    assert set(rows) == {("one", "large.txt"), ("one", "two/x.py"), ("two", "x.py")}
    assert rows[("one", "large.txt")]["read_status"] == "large" and rows[("one", "large.txt")]["content"] == ""


def test_tree_reads_large_text_whole_unless_told(spark, tmp_path):
    (tmp_path / "large.py").write_text("def f():\n    return 1\n" + "# TODO x\n" * (fixed.READ_LIMIT // 9 + 9))
    row = tree.read_tree(spark, path=str(tmp_path)).first()
    assert row["read_status"] == "ok" and len(row["content"]) == row["size_bytes"] > fixed.READ_LIMIT


def test_unreadable_root_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(Exception):
        tree.read_tree(spark, path=str(tmp_path / "none")).collect()


def test_listing_opens_nothing_and_prunes(spark, tmp_path):
    from filestrata.sources.listing import ListingReader, list_tree, read_listed

    for i in range(25):
        (tmp_path / "flat").mkdir(exist_ok=True)
        (tmp_path / "flat" / f"f{i:02d}.py").write_text("x = 1\n" * i)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.md").write_text("# A\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x").write_text("x")
    os.mkfifo(tmp_path / "flat" / "pipe.py")  # reading it would wait for ever
    found = list_tree(spark, roots=f"p={tmp_path}", share="4")
    rows = {r["path"]: r["size_bytes"] for r in found.collect()}
    assert rows == {**{f"flat/f{i:02d}.py": 6 * i for i in range(25)}, "flat/pipe.py": 0, "deep/er/a.md": 4}
    assert found.rdd.getNumPartitions() >= 7
    some = found.filter("path LIKE 'flat/f1%' AND size_bytes > 90 AND project_id = 'p' AND path <> 'flat/f18.py'")
    assert sorted(r["path"] for r in some.collect()) == ["flat/f16.py", "flat/f17.py", "flat/f19.py"]
    files = read_listed(some, {"p": str(tmp_path)}, with_bytes=True).collect()
    assert {r["path"]: (r["lines"], len(r["content_bytes"])) for r in files} == {f"flat/f{i}.py": (i + 1, 6 * i) for i in (16, 17, 19)}
    assert found.filter("project_id = 'other'").count() == 0
    reader = ListingReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import StringStartsWith
    assert list(reader.pushFilters([StringStartsWith(("path",), "deep/")])) == []
    assert {os.path.basename(p.folder) for p in reader.partitions()} == {tmp_path.name, "deep", "er"}
    with pytest.raises(Exception, match="none"):
        list_tree(spark, path=str(tmp_path / "none")).collect()


def test_large_source_keeps_its_symbols(spark, make_files):
    from filestrata.sources.pyfacts import python_facts

    source = "def f():\n    return 1\n" + "# TODO x\n" * (fixed.READ_LIMIT // 9 + 9)
    row = python_facts(make_files({"p": {"large.py": source}})).first()
    assert row["todo_count"] > 0 and len(row["facts"]["functions"]) == 1


def _dumps(spark, *texts):
    return spark.createDataFrame([(i, name, t) for i, (name, t) in enumerate(texts)], "dump_id long, file_name string, text string")


def _document(parts):
    rows = parts.orderBy(*dumps.ORDER).collect()
    return "\n".join(r["block"] for r in rows)


FILES = {"p": {"a/x.py": "  print('&<>')\n\n", "B.md": "text `q`\n# h", "n": "no text", "LICENSE": "free"}}


def test_json_round_trip_is_exact(spark, make_files):
    files = make_files(FILES)
    rows = dumps.full_json_dump(files).filter("section = 1").collect()
    document = '{"format": "full-content-json", "metadata": {"root": "/x/p"}, "files": [' + ",".join(r["block"] for r in rows) + "]}"
    back = recovery.recovered(_dumps(spark, ("d.json", document))).collect()
    assert {r["path"]: r["content"] for r in back} == {"a/x.py": "  print('&<>')\n\n", "B.md": "text `q`\n# h", "LICENSE": "free"}


def test_markdown_round_trip_is_trimmed(spark, make_files):
    document = _document(dumps.markdown_dump(make_files(FILES)))
    assert document.startswith("# Project Structure: p\n\n")
    back = recovery.recovered(_dumps(spark, ("d.md", document))).collect()
    assert {r["path"]: r["content"] for r in back} == {
        "a/x.py": "print('&<>')\n", "B.md": "text `q`\n# h\n", "LICENSE": "free\n"}


def test_html_round_trip(spark, make_files):
    body = _document(dumps.html_blocks(make_files(FILES)))
    document = "<!DOCTYPE html>\n<title>Project Structure: p</title>\n" + body
    back = recovery.recovered(_dumps(spark, ("d.html", document))).collect()
    assert {r["path"]: r["content"] for r in back} == {
        "a/x.py": "\n  print('&<>')\n", "B.md": "\ntext `q`\n# h\n", "LICENSE": "\nfree\n"}


def test_html_pairs_headings_with_the_next_block(spark):
    document = ("<html><title>Project Structure: p</title><h3>no code</h3><h3><code> a.py </code></h3><div>d</div>"
                "<pre>no code</pre><pre><code>A &amp; B</code></pre><h3>x <code>b.py</code></h3><pre><code>C</code></pre>")
    back = recovery.from_html(_dumps(spark, ("d.html", document))).collect()
    assert [(r["path"], r["content"]) for r in back] == [("a.py", "A & B"), ("b.py", "C")]


def test_markdown_fence_inside_a_file_truncates(spark):
    block = "### 📄 `a.md`\n\n**Size:** 1 KB\n\n```md\nbefore\n```\nafter\n```\n"
    rows = recovery.from_markdown(_dumps(spark, ("d.md", "# Project Structure: p\n" + block))).collect()
    assert [r["content"] for r in rows] == ["before\n"]
    bare = block.replace("```md", "```")
    assert recovery.from_markdown(_dumps(spark, ("d.md", bare)), "lenient").first()["content"] == "before\n"


def test_unsafe_paths_are_left_out(spark):
    found = spark.createDataFrame(
        [(0, p, "c") for p in ("ok/a.py", "../up", "a/../b", "/abs", "C:/x", "a..b", "")],
        "dump_id long, path string, content string")
    assert {r["path"] for r in recovery.recovered_files(found, "json").collect()} == {"ok/a.py", "a..b"}


def test_newline_dialects(spark):
    found = spark.createDataFrame([(0, "a", "\n\nx \n\n")], "dump_id long, path string, content string")
    out = {d: recovery.recovered_files(found, d).first()["content"] for d in ("json", "full", "plain")}
    assert out == {"json": "\n\nx \n\n", "full": "\n\nx\n", "plain": "x \n"}


def test_formats_and_names(spark):
    table = _dumps(spark, ("a.md", "This report includes complete source code content"), ("a.json", "{bad"),
                   ("a.json", '{"format":"full-content-json"}'), ("a.txt", "# Project Structure:  N \n"),
                   ("a.html", "<title>Project Structure: T</title><pre><code>"), ("r.json", '{"root": "/a/b/"}'))
    rows = table.select("dump_id", recovery.detected_format(F.col("file_name"), F.col("text")).alias("f"),
                        recovery.project_name(F.col("text")).alias("n")).orderBy("dump_id").collect()
    assert [r["f"] for r in rows] == ["full-content-markdown", "unknown", "full-content-json", "unknown", "legacy-html", "unknown"]
    assert [r["n"] for r in rows] == ["project_root", "project_root", "project_root", "N", "T", "b"]


def test_written_dump_keeps_the_order(spark, make_files, tmp_path):
    files = make_files({"p": {f"f{i:03d}.md": f"text {i}" for i in range(40)}})
    dumps.write_dump(dumps.markdown_dump(files), str(tmp_path / "out"))
    folder = tmp_path / "out" / "project_id=p"
    text = "".join((folder / name).read_text() for name in sorted(os.listdir(folder)) if name.endswith(".txt"))
    assert text.startswith("# Project Structure: p")
    places = [text.index(f"`f{i:03d}.md`") for i in range(40)]
    assert places == sorted(places)


def test_plain_text_lines_lose_trailing_space(spark, make_files):
    block = dumps.plaintext_dump(make_files({"p": {"a.md": "x  \n\ty\t\n\n"}})).filter("section = 1").first()["block"]
    assert block.endswith("-" * 40 + "\nx\n\ty\n")
