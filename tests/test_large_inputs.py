"""What keeps jobs whole on large inputs: no broadcast of files, bounded pieces, rows over all cores."""
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from filestrata.catalog import exchange
from filestrata.llm import components, frames, near_copies
from filestrata.operators import cycles, graph, joins, symbols
from filestrata.schemas import FACTS
from filestrata.sources import dumps, pyfacts, recovery, tree
from filestrata.sources.tables import linked_sources, part_sources

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_and_facts_meet_without_broadcast(spark):
    files = part_sources(spark, SF)
    facts = pyfacts.python_facts(files)
    analysis = symbols.engine_analysis(files, facts)
    for df in (analysis, dumps.analysis_json(analysis, files), graph.call_graph(files, facts)):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)


def test_sources_are_made_in_many_tasks(spark):
    for files in (part_sources(spark, SF), linked_sources(spark, SF)):
        assert "REPARTITION_BY_NUM" in _plan(files)


@pytest.mark.parametrize("name", ["import_cycles", "dependency_layers", "hubs"])
def test_rounds_over_many_modules_broadcast_nothing(spark, monkeypatch, name):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a"), ("p", "c", "a"), ("p", "d", "c")], "project_id string, source string, target string")
    want = {tuple(r) for r in getattr(cycles, name)(edges).collect()}
    monkeypatch.setattr(cycles, "FEW", 0)
    monkeypatch.setattr(cycles.F, "broadcast", None)
    assert {tuple(r) for r in getattr(cycles, name)(edges).collect()} == want


def test_rounds_have_small_plans(spark, monkeypatch):
    ring = [("p", f"m{i}", f"m{(i + 1) % 4}") for i in range(4)]
    chain = [("p", f"m{i}", f"m{i + 1}") for i in range(3, 8)] + [("p", "m8", "m7")]
    edges = spark.createDataFrame(ring + chain, "project_id string, source string, target string")
    kept, plans, sizes = cycles.stored, [], []

    def watched(df):
        plans.append(_plan(df).count("Join"))
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return kept(df)

    monkeypatch.setattr(cycles, "stored", watched)
    monkeypatch.setattr(cycles, "FEW", 0)
    got = {(r["module"], r["cycle"], r["layer"]) for r in cycles.dependency_layers(edges).collect()}
    want = {(f"m{i}", "m0", 4) for i in range(4)} | {("m4", "m4", 3), ("m5", "m5", 2), ("m6", "m6", 1), ("m7", "m7", 0), ("m8", "m7", 0)}
    assert got == want
    assert len(plans) > 15 and max(plans) <= 4 and max(map(int.bit_length, sizes)) < 256


def test_joins_beyond_the_limit_broadcast_nothing(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    rows, table = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    for how, n in (("inner", 50), ("left", 100)):
        for df in (joins.lookup_join(rows, table, ["k"], ["k"], how), joins.sized_join(rows, table, ["k"], how)):
            assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)
            assert df.count() == n and df.agg({"v": "sum"}).first()[0] == 2450


def test_components_beyond_the_limit_broadcast_nothing(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    monkeypatch.setattr(components, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(joins.F, "broadcast", None)
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(21)}


def test_near_copies_beyond_the_limit_broadcast_nothing(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join(words[:-2]), " ".join(words[2:]), "something else", "", None]
    texts += [" ".join(f"v{i * j}" for i in range(60)) for j in range(1, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(near_copies.near_copies(docs).collect())
    left = sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect())
    assert [r["component_id"] for r in want][:4] == [0] * 4 and left[:2] == [0, 4]
    monkeypatch.setattr(near_copies, "BROADCAST", -1)
    monkeypatch.setattr(joins.F, "broadcast", None)
    assert sorted(near_copies.near_copies(docs).collect()) == want
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect()) == left


def test_facts_by_column_equal_facts_by_row():
    sources = ["import a.b, c\nfrom . import d\nclass A(B, m=C[int]):\n  'doc'\n  def f(self, x: 'int' = 1, *, y): return x\n",
               "if 'x' and __name__ == '__main__':\n  f(g(1), k='v')[2]\n", "def broken(:\n", "", "global x\nx = '\\ud800é'\n"]
    rows = [pyfacts.facts(s) for s in sources]
    kind = to_arrow_schema(FACTS)
    for field in kind:
        values = [r.get(field.name) for r in rows]
        assert pyfacts._column(values, field.type).equals(pa.array(values, type=field.type))
    assert [r.get("main_guard") for r in rows] == [False, True, None, False, False]


def test_facts_are_made_in_slices(spark, make_files, monkeypatch):
    sources = {f"m{i}.py": f"import a{i}\nclass C{i}(a.b.D): x = f(g('{i}'))[0]\n" if i % 5 else "def broken(:\n" for i in range(23)}
    files = make_files({"p": sources})
    want = {r["path"]: r["facts"] for r in pyfacts.python_facts(files).collect()}
    monkeypatch.setattr(pyfacts, "_SLICE", 4)
    assert {r["path"]: r["facts"] for r in pyfacts.python_facts(files).collect()} == want and len(want) == 23
    assert want["m7.py"]["classes"][0]["bases"] == ["a.b.D"] and want["m5.py"]["parse_ok"] is False


def test_names_need_no_unparser(monkeypatch):
    monkeypatch.setattr(pyfacts.ast, "unparse", None)
    found = pyfacts.facts("@a.b\ndef f(x: c.d, *y: e) -> g.h:\n  with i.j(k) as z: n.o(m['p'])\n  if q: r.s\nclass T(u.v): pass\n")
    kind = to_arrow_schema(FACTS)
    function, = pyfacts._column(found["functions"], kind.field("functions").type.value_type).to_pylist()
    assert function["args"][0] == {"slot": "plain", "name": "x", "note": "c.d", "note_name": "c.d"}
    assert (function["returns"], function["decorators"], function["branches"]) == ("g.h", ["a.b"], 2)
    assert [c[:2] for c in found["calls"]] == [("i.j", "i.j"), ("n.o", "n.o")]


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 18])
def test_trees_are_counted_in_pieces(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(tree, "PIECE", piece)
    texts = ["two words\r\nof three \x1c lines\n", "", " \n\t", "wordé\u3000x", "a", "\n b\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_bytes(text.encode() + b"\xff")
    for i, text in enumerate(texts):
        file = tmp_path / f"f{i}.txt"
        whole = file.read_text(errors="ignore")
        counts = (whole.count("\n") + 1, len(whole.split())) if whole.strip() else (0, 0)
        assert tree._text_of(str(file), 0, file.name, None, False) == (None, *counts, "ok")
        assert tree._text_of(str(file), 0, file.name, None) == (whole if whole.strip() else "", *counts, "ok")
        assert tree._digest_of(str(file)) == hashlib.sha256(file.read_bytes()).hexdigest()


def test_tree_scan_holds_no_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0\1" * 1000)
    (tmp_path / "b.txt").write_text("some words")
    got = {r["path"]: (r["size_bytes"], r["sha256"]) for r in exchange._tree_scan(spark, str(tmp_path)).collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    rows = tree.read_tree(spark, path=str(tmp_path), digest="true", content="false").collect()
    assert all(r["content"] is None and r["content_bytes"] is None for r in rows)


def test_html_is_read_in_slices(spark, monkeypatch):
    text = "<title>Project Structure: x</title><h3><code>a{0}.py</code></h3><pre><code>text {0}</code></pre>"
    docs = spark.createDataFrame([(i, text.format(i)) for i in range(20)], "dump_id long, text string").coalesce(1)
    monkeypatch.setattr(recovery, "HELD_BYTES", 300)
    got = {tuple(r) for r in recovery.from_html(docs).collect()}
    assert got == {(i, f"a{i}.py", f"text {i}") for i in range(20)}


def test_kept_values_are_forgotten():
    frames.kept("something", lambda: [1])
    frames.forget()
    assert frames.kept("something", lambda: [2]) == [2]
    frames.forget()


def test_forgotten_memory_goes_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    # Pieces too small for pages of their own; the last one pins the heap's end.
    held = [bytearray(50_000) for _ in range(2_000)]
    pin = bytearray(50_000)
    before = resident()
    held.clear()
    frames.forget()
    assert len(pin) and before - resident() > 50_000_000
