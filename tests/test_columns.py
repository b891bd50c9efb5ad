"""Column functions against Python's own behaviour on awkward strings."""
import fnmatch
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from filestrata.functions import paths, scores, text

TEXTS = [
    "", " ", "a", "a b", "a\u00a0b\u3000c", "x\x0by\x0cz", "one\ntwo\r\nthree\rfour\x85five\u2028six\u2029seven",
    "\n\n  \t\n", "tail\n", "tail\r\n\r\n", " \u2003lead and trail\u2003 ", "\x1cfs\x1dgs\x1ers\x1fus",
    "# TODO: a\n#fixme b\n#\u00a0XXX\nTODOS todo éTODO TODO_", "éabcd 9abcd §1 _abc",
    "# h1\n ## h2 #\nplain #\n#", "\n".join(f"line {i}" for i in range(25)), "\n".join("x" * 10) + "\n",
    "// Copyright\n" + "\n" * 30, "\n" * 25 + "license", "\"k\": 1 'v' = 2 \"a.b-c\"\u00a0: 3 \"no\" 4",
]


def _apply(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row["out"] for row in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def _preview(t, n=10):
    lines = t.splitlines()
    return t if len(lines) <= n else "\n".join(lines[:n]) + f"\n... ({len(lines) - n} more lines)"


@pytest.mark.parametrize("column, expected", [
    (text.word_count, lambda t: len(t.split())),
    (text.line_count, lambda t: t.count("\n") + 1 if t.strip() else 0),
    (text.sloc, lambda t: sum(1 for line in t.splitlines() if line.strip())),
    (text.strip, str.strip),
    (text.rstrip, str.rstrip),
    (text.stripped_lines, lambda t: [line.strip() for line in t.splitlines() if line.strip()]),
    (text.comment_markers, lambda t: len(re.findall(r"#\s*(TODO|FIXME|XXX)", t, re.I))),
    (text.word_markers, lambda t: len(re.findall(r"\b(TODO|FIXME|XXX)\b", t, re.I))),
    (text.preview, _preview),
    (lambda c: text.headings(c, 3), lambda t: [x.strip("# ") for x in t.splitlines() if x.startswith("#")][:3]),
    (lambda c: text.headings(c, 3, True),
     lambda t: [x.strip("# ") for x in t.splitlines() if x.strip().startswith("#")][:3]),
    (text.has_licence_header,
     lambda t: any(w in "\n".join(t.splitlines()[:20]).lower() for w in ("license", "copyright"))),
    (text.config_keys, lambda t: sorted(set(re.findall(r"[\"']([A-Za-z0-9_.-]+)[\"']\s*[:=]", t)))),
    (lambda c: F.array_join(text.tokens(c), ""), lambda t: t),
    (text.normalise_eol, lambda t: (t.replace("\r\n", "\n").replace("\r", "\n").rstrip() + "\n") if t else t),
    (lambda c: text.normalise_eol(c, "KEEP"), lambda t: t.replace("\r\n", "\n").replace("\r", "\n")),
])
def test_text_functions(spark, column, expected):
    assert _apply(spark, TEXTS, column) == [expected(t) for t in TEXTS]


def test_summary_of_empty_text(spark):
    assert _apply(spark, ["", " \n"], lambda c: text.summary(c, F.lit("f.py"))) == [["f.py (empty)"]] * 2


PATHS = ["a/b.py", "x.tar.gz", ".gitignore", "d/.env", "X.R", "a..b", "..a", "a.", "README", "d/Makefile", ".a.b",
         "pkg/__init__.py", "A.PY", "n/a.md"]


def test_path_parts(spark):
    assert _apply(spark, PATHS, paths.suffix) == [PurePosixPath(p).suffix.lower() for p in PATHS]
    assert _apply(spark, PATHS, paths.stem) == [PurePosixPath(p).stem for p in PATHS]
    assert _apply(spark, PATHS, paths.name) == [PurePosixPath(p).name for p in PATHS]
    assert _apply(spark, PATHS, paths.parent) == [p.rpartition("/")[0] for p in PATHS]


def test_text_predicate(spark):
    names = ["a.R", "a.gitignore", ".gitignore", "makefile", "MAKEFILE", "Dockerfile", "b.png", "c.JSON", "notes"]
    assert _apply(spark, names, paths.is_text) == [True, True, False, True, True, True, False, True, False]


def test_visibility(spark):
    names = ["a/b.py", ".git/x", "a/.env", "_priv/d.py", "a/__pycache__/b.pyc", "THUMBS.DB", "a/Desktop.ini",
             "a/__pycache__x", ".DS_Store", "a.git/b"]
    assert _apply(spark, names, paths.is_visible) == [
        True, False, False, True, False, False, False, True, False, True]


@pytest.mark.parametrize("pattern", [
    "**", "*.py", "**/.git/**", "src/*", "a?b", "[ab]*.md", "[!ab]*.md", "x[.]y", "a+b(c)", "*[]]*", "[a-c]/[^d]*"])
def test_globs(spark, pattern):
    names = [".git/x", "a/.git/x", "src/a/b.py", "axb", "a.md", "c.md", "x.y", "a+b(c)", "q]q", "b/^d1", "b/e"]
    found = _apply(spark, names, lambda c: paths.glob_selected(c, [pattern], []))
    assert found == [fnmatch.fnmatchcase(n, pattern) for n in names]


def test_glob_exclude_wins(spark):
    found = _apply(spark, ["a.py", "b.py", "c.md"], lambda c: paths.glob_selected(c, ["*.py"], ["a*"]))
    assert found == [False, True, False]
    assert _apply(spark, ["a", "b"], lambda c: paths.glob_selected(c, [], ["a"])) == [False, True]


def test_mime(spark):
    names = ["a.tar.gz", "a.tgz", "b.svgz", "c.json", "d.unknown", "e.HTML", "f.csv.bz2"]
    assert _apply(spark, names, paths.mime_type) == [
        "application/x-tar", "application/x-tar", "image/svg+xml", "application/json", None, "text/html", "text/csv"]


def test_sizes_round_halves_to_even(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1536, 1024 * 1024 + 1024 * 51, 5 * 1024 ** 3]

    def shown(n):
        size = float(n)
        for unit in ("B", "KB", "MB", "GB"):
            if size < 1024:
                return f"{size:.1f} {unit}"
            size /= 1024

    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long")
    rows = df.select("i", text.file_size(F.col("n")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [shown(n) for n in sizes]


def test_bands(spark):
    row = spark.range(1).select(
        scores.risk_band(scores.risk_score(F.lit(4), F.lit(199), F.lit(0))).alias("low"),
        scores.risk_band(scores.risk_score(F.lit(4), F.lit(200), F.lit(0))).alias("medium"),
        scores.risk_band(scores.risk_score(F.lit(14), F.lit(0), F.lit(2))).alias("high"),
        scores.risk_band(F.lit(None).cast("double")).alias("none"),
        scores.hotspot(F.lit(500), F.lit(1)).alias("hot")).first()
    assert tuple(row) == ("low", "medium", "high", "not-computed", 10.0)
