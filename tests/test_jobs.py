"""Distributed jobs against brute force, with their thresholds lowered so that every path runs."""
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filestrata.operators import dictionary, directories, fingerprint, joins, merkle, numbering, packing, selection
from filestrata.operators import cards, catalogues, graph, symbols
from filestrata.plans import bundle, capsule, corpus
from filestrata.session import frozen
from filestrata.sources.pyfacts import python_facts


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _brute_force_tree(hashes):
    level, nodes, n = list(hashes), [], 0
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 2):
            n += 1
            above.append(_sha("".join(level[i:i + 2])))
            nodes.append((f"n-{n:04d}", above[-1]))
        level = above
    return sorted(nodes), level[0]


@pytest.mark.parametrize("span", [2, 10])
def test_hash_tree(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    sizes = {"p1": 1, "p2": 2, "p3": 3, "p5": 5, "p8": 8, "p9": 9, "big": 1500}
    leaves = {p: [_sha(f"{p}{i}") for i in range(n)] for p, n in sizes.items()}
    rows = [(p, len(h), i, x) for p, h in leaves.items() for i, x in enumerate(h)]
    df = spark.createDataFrame(rows, "project_id string, total long, idx long, hash string")
    nodes = frozen(merkle.hash_tree(df))
    roots = {r["project_id"]: r["root"] for r in merkle.tree_root(df, nodes).collect()}
    found = {}
    for r in nodes.collect():
        found.setdefault(r["project_id"], []).append((r["node_id"], r["hash"]))
    for project, hashes in leaves.items():
        expected, root = _brute_force_tree(hashes)
        assert sorted(found.get(project, [])) == expected
        assert roots[project] == root
    assert spark.range(1).select(merkle.empty_root().alias("h")).first()["h"] == _sha("")


def test_numbering_with_one_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.randrange(10 ** 6) * 10 + i % 7, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(7)
    got = {r["i"]: (r["number"], r["total"]) for r in numbering.number_rows(df, ["g"], ["k", "i"]).collect()}
    by_group = {}
    for g, k, i in rows:
        by_group.setdefault(g, []).append((k, i))
    expected = {i: (n, len(m)) for m in by_group.values() for n, (_, i) in enumerate(sorted(m), 1)}
    assert got == expected


def test_numbering_shuffled_offsets_equal_broadcast_ones(spark, monkeypatch):
    monkeypatch.setattr(numbering, "fits_broadcast", lambda df: False)
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id"))
    rows = numbering.number_rows(df, ["g"], ["id"]).collect()
    assert all(r["number"] == r["id"] // 3 + 1 for r in rows)


@pytest.mark.parametrize("fits", [True, False])
def test_lookup_join_paths_agree(spark, monkeypatch, fits):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: fits)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                    F.col("id"))
    table = spark.createDataFrame([("hot", 1), ("4", 2)], "k string, v int")
    left = joins.lookup_join(rows, table, ["k"], ["id"]).collect()
    assert len(left) == 1000 and sum(r["v"] or 0 for r in left) == 334 + 2
    inner = joins.lookup_join(rows, table, ["k"], ["id"], "inner")
    assert inner.count() == 335 and set(inner.columns) == {"k", "id", "v"}


def test_fingerprint(spark, make_files, monkeypatch):
    monkeypatch.setattr(fingerprint, "CHUNK", 3)
    names = ["a-b/c.py", "a/b.py", "a.b.py", "A/z.py", *[f"m{i}.py" for i in range(11)]]
    files = make_files({"p": {n: n for n in names}, "q": {"x.py": "12345"}})
    def plain(order):
        return _sha("".join(f"{n}::{len(n)}" for n in sorted(names, key=order)))
    got = {r[0]: r[1] for r in fingerprint.project_fingerprint(files).collect()}
    assert got == {"p": plain(None), "q": _sha("x.py::5")}
    parts = {r[0]: r[1] for r in fingerprint.project_fingerprint(files, by_components=True).collect()}
    assert parts["p"] == plain(lambda n: n.split("/"))
    changed = make_files({"p": {n: n.upper() for n in names}})
    assert fingerprint.project_fingerprint(changed).first()["fingerprint"] == plain(None)


WORDS = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")


def _corpus():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)] + ["éabcd", "9abcd", "§7", "abc", "_abc", "tie_a", "tie_b"]
    return {f"p{p}": {f"d{i % 3}/f{i:02d}.md": " ".join(rng.choices(vocabulary, k=40)) + "."
                      for i in range(12)} for p in range(3)}


@pytest.mark.parametrize("size", [5, 40, 200])
def test_dictionary_equals_counter(spark, make_files, size):
    projects = _corpus()
    texts = make_files(projects).select("project_id", "path", "content")
    made = dictionary.token_dictionary(texts, size)
    got = {}
    for r in made.orderBy("project_id", "rank").collect():
        got.setdefault(r["project_id"], []).append((r["token"], r["word"], r["n"]))
    for project, files in projects.items():
        counter = Counter(w for path in sorted(files) for w in WORDS.findall(files[path]))
        expected = [(f"§{i}", w, n) for i, (w, n) in enumerate(counter.most_common(size), 1)]
        assert got[project] == expected


def test_dictionary_sample_is_a_parameter(spark, make_files):
    files = make_files({"p": {"a.md": "alpha beta" + " gamma" * 9}}).select("project_id", "path", "content")
    assert {r["word"] for r in dictionary.token_dictionary(files, 9, sample_chars=10).collect()} == {"alpha", "beta"}
    assert dictionary.token_dictionary(files, 1).first()["word"] == "gamma"


@pytest.mark.parametrize("fits", [True, False])
def test_substitution_is_whole_word_and_reversible(spark, make_files, monkeypatch, fits):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: fits)
    projects = {"p": {"a.md": "alpha alphabet _alpha éalpha alpha-alpha 9alpha alpha", "b.md": "none"}, "q": {"c.md": "x y"}}
    texts = make_files(projects).select("project_id", "path", "content")
    made = frozen(dictionary.token_dictionary(texts, 1))
    rows = {r["path"]: r for r in dictionary.substitute(texts, made).collect()}
    assert rows["a.md"]["payload"] == "§1 alphabet _alpha éalpha §1-§1 9alpha §1"
    assert rows["a.md"]["tokens_used"] == ["§1"] and rows["b.md"]["tokens_used"] == []
    assert rows["c.md"]["payload"] == "x y"
    back = {r["token"]: r["word"] for r in made.filter("project_id = 'p'").collect()}
    assert re.sub(r"§\d+", lambda m: back[m[0]], rows["a.md"]["payload"]) == projects["p"]["a.md"]


def test_directories_and_states(spark, make_files):
    files = make_files({"p": {"a/b/c.py": "1", "a/d.py": "22", "e.py": "333"}})
    rows = {r["dir"]: r for r in directories.directory_rollup(files).collect()}
    assert {d: (r["n_files"], r["bytes"], r["n_direct_files"], r["n_subdirs"], r["parent"]) for d, r in rows.items()} == {
        "": (3, 6, 1, 1, None), "a": (2, 3, 1, 1, ""), "a/b": (1, 1, 1, 0, "a")}
    chosen = files.select("project_id", "path", F.col("path").startswith("a/b").alias("selected"))
    states = {r["dir"]: r["state"] for r in directories.selection_rollup(chosen).collect()}
    assert states == {"": "mixed", "a": "mixed", "a/b": "all"}


def test_selection(spark, make_files):
    files = make_files({"p": {"a.py": "1", "b.py": "2"}, "q": {"c.py": "3"}})
    chosen = spark.createDataFrame([("p", "a.py", True), ("p", "b.py", None)], "project_id string, path string, selected boolean")
    kept = {r["path"]: r["content"] for r in selection.apply_selection(files, chosen).collect()}
    assert kept == {"a.py": "1", "b.py": None, "c.py": None}
    assert selection.apply_selection(files, None) is files
    assert [r["path"] for r in selection.stored_exclusions(chosen).collect()] == ["b.py"]


CODE = '''
import os, a.b
from . import x
from .a import y
from pkg.mod import z as w

class C(unittest.TestCase, tk.Toplevel, Toplevel):
    @deco.rate(1)
    def test_m(self):
        def inner():
            if True:
                pass
        try:
            with open("f") as f: pass
        except ValueError:
            pass
        return a and b or c

async def go(p, /, q: int, *rest: str, k=1, **kw: Any):
    """

    First line.
    Second."""
    async for _ in q: pass
    get().inner.call(env="E1", my_ENV="E2", other="no")
    environ["E3"]; os.environ["E4"]; os.environ.get("E5", 1); getenv(name)
    if __name__ == "__main__":
        pass

def test_top(*, only): pass
'''


def test_facts_and_dialects(spark, make_files):
    files = make_files({"p": {"pkg/m.py": CODE, "pkg/bad.py": "def (", "pkg/nul.py": "a\\x00 = '\\ud800'", "t.md": "# x"}})
    facts = frozen(python_facts(files))
    assert {r["path"]: r["facts"]["parse_ok"] for r in facts.collect()} == {
        "pkg/m.py": True, "pkg/bad.py": False, "pkg/nul.py": False}
    one = facts.filter("path = 'pkg/m.py'")
    row = one.select(
        symbols.engine_import_list().alias("imports"), symbols.deep_import_set().alias("deep"),
        symbols.env_var_set().alias("env"), symbols.deep_test_set().alias("tests"),
        symbols.engine_test_list().alias("etests"), symbols.entrypoint_set().alias("entry"),
        symbols.ui_base_list(True).alias("windows"), symbols.ui_base_list(False).alias("widgets"),
        symbols.engine_complexity().alias("cc"), symbols.deep_complexity().alias("dcc"),
        symbols.outline(20).alias("outline")).first()
    assert row["imports"] == ["os", "a.b", "", "a", "pkg.mod"]
    assert row["deep"] == ["a.b", "a.y", "os", "pkg.mod.z", "x"]
    assert row["env"] == ["E1", "E2", "E3", "E4", "E5"]
    assert row["tests"] == ["C", "test_top"]
    assert row["etests"] == ["pkg/m.py::test_top", "pkg/m.py::test_m"]
    assert row["entry"] == ["go", "pkg/m.py::<module>"]
    assert row["windows"] == ["Toplevel"] and row["widgets"] == []
    assert row["cc"] == (1 + 3) + (1 + 1) + (1 + 2) + 1  # test_m with inner, inner, go, test_top
    assert row["dcc"] == 1 + 1 + 1 + 1 + 4 + 1  # if, try, with, two boolean expressions, guard
    names = [(s["kind"], s["name"]) for s in row["outline"]["symbols"]]
    assert names == [("class", "C"), ("async", "go(q: int, *rest, k, **kw)"), ("func", "test_top(only)")]
    assert row["outline"]["calls"] == ["open", "deco.rate", "inner.call", "get", "os.environ.get", "getenv"]
    deep = {r["qualname"]: (r["signature"], r["doc"]) for r in symbols.functions(one, "deep").collect()}
    assert deep["go"] == ("go(p, /, q: int, *rest: str, k, **kw: Any)", "First line.")
    assert deep["test_top"][0] == "test_top(*, only)"
    engine = {r["qualname"]: r["signature"] for r in symbols.functions(one, "engine").collect()}
    assert engine["go"] == "async go(q: int, *rest, **kw)"
    assert "get().inner.call" in {r["value"] for r in symbols.values(one, symbols.call_target_set()).collect()}


def test_imports_inside_and_outside(spark, make_files):
    files = make_files({"p": {"pkg/a.py": "import pkg.b, os, c", "c.py": "import a", "x.PY": ""}, "q": {"m.py": "import pkg"}})
    found = graph.classified_imports(symbols.imports(python_facts(files), "deep"), files)
    got = {(r["project_id"], r["path"], r["module"]): r["internal"] for r in found.collect()}
    assert got == {("p", "pkg/a.py", "pkg.b"): True, ("p", "pkg/a.py", "os"): False, ("p", "pkg/a.py", "c"): True,
                   ("p", "c.py", "a"): True, ("q", "m.py", "pkg"): False}
    edges = graph.resolved_edges(symbols.imports(python_facts(files), "deep"), files, "resolved").collect()
    assert {(r["source"], r["target"]) for r in edges} == {("pkg.a", "c")}


def test_cards_drop_disabled_parts(spark, make_files):
    files = make_files({"p": {"a.py": "X = 'lit'", "b.md": "hello", "c.py": "def ("}})
    facts = frozen(python_facts(files))
    full = cards.file_cards(files, facts)
    rows = {r["path"]: r for r in full.collect()}
    assert rows["a.py"]["strings"] == ["lit"] and rows["b.md"]["strings"] == ["hello"]
    assert rows["c.py"]["responsibility"] == "Unparseable Python file" and rows["c.py"]["complexity"] == "not-computed"
    for part, column in (("string_catalogue", "strings"), ("tests", "tests"), ("functions", "functions"),
                         ("config_schema", "config_keys"), ("binary_manifest", "asset_mime")):
        assert column in full.columns
        assert column not in cards.file_cards(files, facts, cards.PARTS - {part}).columns
    less = cards.file_cards(files, facts, cards.PARTS - {"complexity_panel"})
    assert {r["complexity"] for r in less.collect()} == {"not-computed"}


def test_string_index(spark, make_files):
    files = make_files({"p": {"a.md": "same\nsame\n" + "y" * 120, "b.md": " same "}})
    postings = catalogues.string_postings(files, python_facts(files))
    assert sorted((r["string"], r["path"]) for r in postings.collect()) == [("same", "a.md"), ("same", "b.md")]
    assert tuple(catalogues.string_index(postings).first()) == ("p", "same", 2, "a.md", "b.md")


def test_packing_round_trip_and_damage(spark, make_files):
    files = make_files({"p": {"a.bin": "x" * 500, "b.bin": ""}})
    packed = packing.packed_files(files)
    assert packing.mismatches(packed).count() == 0
    damaged = packed.withColumn("sha256", F.when(F.col("path") == "a.bin", "0").otherwise(F.col("sha256")))
    assert [r["path"] for r in packing.mismatches(damaged).collect()] == ["a.bin"]


def test_capsule_options(spark, make_files):
    files = make_files({"p": {
        ".git/x.md": "kept at the root", "a/.git/x.md": "dropped", "s.py": "def f(a, *, b): pass\nf(1)\n", "t.md": "# Head\n",
        "big.md": "z" * 3000, "i.png": "binary"}})
    plain = capsule.Capsule(files, capsule.CapsuleOptions(max_file_size=2000))
    assert [r["path"] for r in plain.sections.orderBy("section_id").collect()] == ["s.py", ".git/x.md", "t.md"]
    assert {r["path"]: r["outline_codec"] for r in plain.layers.collect()}["s.py"] == "ast_norm_v1"
    wide = capsule.Capsule(files, capsule.CapsuleOptions(include_binary=True))
    kinds = {r["path"]: (r["section_id"], r["kind"]) for r in wide.sections.collect()}
    assert kinds["i.png"] == ("sec-0001", "binary")
    changed = capsule.Capsule(files.withColumn("content_bytes", F.when(F.col("path") == "t.md", F.encode(F.lit("new"), "UTF-8"))
                                               .otherwise(F.col("content_bytes"))), capsule.CapsuleOptions(max_file_size=2000))
    assert plain.roots.first()["root"] != changed.roots.first()["root"]
    assert plain.roots.first()["root"] == capsule.Capsule(files, capsule.CapsuleOptions(max_file_size=2000)).roots.first()["root"]


def test_capsule_text_replaces_bad_bytes(spark):
    for raw in (b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98", b"ok\xc3\x28", b"\xed\xa0\x80"):
        row = spark.createDataFrame([(bytearray(raw),)], "content_bytes binary").select(capsule._valid_text().alias("t")).first()
        assert row["t"] == raw.decode("utf-8", errors="replace")


def test_corpus_equals_whole_document(spark, make_files):
    files = make_files({"p": {"b.py": "import os\nclass K:\n  '''Doc.'''\n  def m(self): pass\ndef f(x): pass\n", "A.md": "hi"}})
    analysis = frozen(symbols.engine_analysis(files, python_facts(files)))
    made, segments = corpus.corpus_document(analysis, 256)
    rows = segments.orderBy("section", "place", "path").collect()
    whole = " ".join(r["content"] for r in rows)
    assert whole == ("Project: p File: A.md Language: markdown Purpose: Core logic File: b.py Language: python "
                     "Purpose: Module integration Import: os Class: K Doc. Method: m Function: f(x) Function: m(self)")
    counter = Counter(re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", whole))
    lookup = {w: f"§{i}" for i, (w, _) in enumerate(counter.most_common(256), 1)}
    for word in sorted(lookup, key=len, reverse=True):
        whole = re.sub(rf"\b{word}\b", lookup[word], whole)
    assert " ".join(r["payload"] for r in rows) == whole
    assert {r["word"]: r["token"] for r in made.collect()} == lookup


def test_bundle_needs_a_known_format(spark, make_files):
    files = make_files({"p": {"a.py": "x = 1"}})
    with pytest.raises(ValueError):
        bundle.bundle(files, ["nothing"])
