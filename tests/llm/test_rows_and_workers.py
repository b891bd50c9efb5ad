"""Stage filters judge rows by themselves, moved rows grow with members, and queries run on workers without the package."""
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filestrata.llm import decontaminate, dom, near_copies, toxicity

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "clean words of one text"), (7, "BAD thing here"), (None, "BAD thing again"), (None, "no harm"), (8, None), (9, ""),
            (10, long), (10, long), (10, long + " more"), (11, long), (12, "other " * 3), (12, "else " * 3)]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, mark int, items string")


def _kept(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_toxic_rows_go_by_their_own_text(docs):
    model = toxicity.Model(0.01, -4.0, {"bad": 8.0})
    kept = toxicity.below(docs, model)
    assert kept.columns == docs.columns
    assert _kept(kept) == sorted([(r["doc_id"], r["text"]) for r in docs.collect() if "BAD" not in (r["text"] or "")], key=repr)
    assert toxicity.below(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("rank,spaces", [(256, 4), (1, 2), (1, 1)])
def test_leaks_go_by_their_own_text(spark, docs, monkeypatch, tmp_path, rank, spaces):
    monkeypatch.setattr(decontaminate, "RANK", rank)
    monkeypatch.setattr(decontaminate, "SPACES", spaces)
    passages = [(1, "BAD thing here"), (2, "BAD thing again"), (3, "nothing of this is there at all in any row")]
    spark.createDataFrame(passages, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    benchmark = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark).collect()
    assert len(found) == docs.count()
    assert sorted((repr(r["doc_id"]), r["items"]) for r in found if r["contaminated"]) == [("7", [1]), ("None", [2])]
    kept = decontaminate.without_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert _kept(kept) == sorted([(r["doc_id"], r["text"]) for r in docs.collect() if "BAD" not in (r["text"] or "")], key=repr)


def test_one_row_of_each_component(docs):
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = _kept(kept)
    # One row of the four near copies, both unlinked texts of each repeated id, and all rows without id or words.
    assert len([r for r in rows if r[0] in (10, 11)]) == 1 and rows.count((12, "other " * 3)) == rows.count((12, "else " * 3)) == 1
    assert [r for r in rows if r[0] not in (10, 11, 12)] == [r for r in _kept(docs) if r[0] not in (10, 11, 12)]
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_copies.near_copies(docs).collect()}
    assert found[11, 56] == (10, False) and found[10, 57] == (10, True) and found[None, 1] == (None, True)


def test_moved_rows_grow_with_the_members(spark, monkeypatch):
    """One bucket of unlinked members: its blocks move a member once for each later band at most, however many members there are."""
    monkeypatch.setattr(near_copies, "PAIRWISE", 8)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    moved = []
    for n in (400, 800, 1600):
        draw = np.random.default_rng(4)
        # All share the first band; the others are drawn from so many keys that unlike members part.
        rows = [(i, 100, [1, *(int(b) * 1000 + int(k) for b, k in enumerate(draw.integers(0, 500, near_copies.BANDS - 1), 2))], 0,
                 draw.integers(0, 2**32, 50, dtype=np.uint64).astype(np.uint32).tobytes()) for i in range(n)]
        nodes = spark.createDataFrame(rows, "node long, n_shingles long, bands array<long>, level int, sample binary").cache()
        rooted = near_copies._rooted(nodes, None, 0, near_copies.BANDS).filter("bucket = 1").withColumn("second", F.lit(-1))
        again = near_copies._unlike(near_copies._dealt_anew(near_copies._unlike(rooted), nodes))
        moved.append(near_copies._in_blocks(again, nodes).count())
    assert all(rows < near_copies.BANDS * n for n, rows in zip((400, 800, 1600), moved)) and moved[0] > 0


def _rows_joined(plan):
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    below = plan.children()
    return own + sum(_rows_joined(below.apply(i)) for i in range(below.size()))


def test_a_node_meets_its_sample_once(spark, monkeypatch):
    """Twelve nodes in a small bucket and a large one, 20 times over: the join with samples has a row per node, and all meet in blocks as before."""
    monkeypatch.setattr(near_copies, "PAIRWISE", 4)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    large = [(b, b, -1, n, n % 3, 0, 12, 8) for b in range(20) for n in range(12)]
    small = [(100 + b, b, -1, n, n, 0, 3, 2) for b in range(20) for n in range(3)]
    unlike = spark.createDataFrame(large + small, "bucket long, band int, second int, node long, root long, main long, size long, rest long")
    nodes = spark.createDataFrame([(n, 50, [1], 0, b"") for n in range(12)], "node long, n_shingles long, bands array<long>, level int, sample binary")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = near_copies._in_blocks(unlike, nodes)
        rows = blocks.collect()
        assert _rows_joined(blocks._jdf.queryExecution().executedPlan()) == 12
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    held = {}
    for r in rows:
        held.setdefault((r["bucket"], r["lb"], r["rb"]), []).append((r["node"], r["side"]))
    assert all(len(x) == len(set(x)) for x in held.values())
    for bucket in (0, 19):
        # Each that asks meets each of the bucket in one block.
        met = [(a, b) for (of, *_), members in held.items() if of == bucket for a, x in members if x & 1 for b, y in members if y & 2]
        assert sorted(met) == [(a, b) for a in range(12) if a % 3 for b in range(12)]
    assert held[100, 0, 0] and sorted(held[100, 0, 0]) == [(0, 2), (1, 3), (2, 3)]


def test_samples_tell_similarity():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2))
    for n in (40, 400, 6000):
        for share in (0.9, 0.75, 0.3):
            # a and b share `both` hashes and have as many of their own each, so that their similarity is the share.
            both = int(round(2 * (n // 2) * share / (1 + share)))
            a, b = base[:n // 2], np.concatenate([base[:both], base[n // 2:n // 2 + n // 2 - both]])
            rows = [dict(zip(("level", "sample"), near_copies.sample(np.sort(x)))) | {
                "node": i, "root": i, "main": 0, "n_shingles": len(x), "bands": [1] * near_copies.BANDS, "band": 0, "second": -1, "side": 3 if i else 2}
                for i, x in enumerate((a, b))]
            found = near_copies._Group(rows, 75).pairs()
            assert (found == [(0, 1)]) == (share >= 0.75), (n, share)


def test_stages_take_empty_and_clashing_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0, name


def test_unclosed_elements_keep_what_follows():
    assert [t for _, t in dom.Page("<p>one</p><select><p>two</p>").runs] == ["one", "two"]
    assert [t for _, t in dom.Page("<svg><path d=1><p>later</p>").runs] == ["later"]
    assert [t for _, t in dom.Page("<p>a</p><script>if (x < 1) {").runs] == ["a"]
    assert len(dom.Page("<b>" * 50_000 + "</i>" * 50_000 + "<li>" * 50_000).tags) == 50_001


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_decontamination", "op9_main_text", "op11_language", "op12_token_alignment", "op13_fill_middle"])
def test_workers_need_no_package(tmp_path, name):
    """The repository is on the driver's path only, by a module search path that workers do not get."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
                 .config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.range(1).rdd.map(lambda x: 1).collect()  # workers start before the repository is importable
        sys.path.insert(0, {REPO!r})
        import __spark_entry__
        print("rows", __spark_entry__.queries()[{name!r}](spark, {SF!r}).count())
    """))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert "rows" in done.stdout, done.stderr[-3000:]


def _items_and_hosts(n_items, change, seed=1):
    """Items of 5 to 100 words out of real texts, and each of some in another text with a fifth of its words replaced."""
    import random

    import duckdb

    draw = random.Random(seed)
    texts = [t.split() for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    texts = [t for t in texts if len(t) > 120]
    items, rows = [], []
    for i in range(n_items):
        words, n = draw.choice(texts), draw.randint(5, 100)
        at = draw.randrange(len(words) - n)
        items.append((i, " ".join(words[at:at + n])))
    for i, item in items[:400]:
        words, host = item.split(), draw.choice(texts)[:300]
        for j in draw.sample(range(len(words)), int(change * len(words))):
            words[j] = f"{draw.choice(draw.choice(texts))}x"
        at = draw.randrange(len(host))
        rows.append((i, " ".join([*host[:at], *words, *host[at:]])))
    return items, rows


@pytest.mark.parametrize("n_items", [200, 2_000])
def test_latent_candidates_hold_changed_passages(spark, n_items):
    """Every passage that an exhaustive search confirms is looked for; the latent candidates hold at least nine tenths of them."""
    items, rows = _items_and_hosts(n_items, 0.2)
    found = {r["doc_id"]: r["items"] for r in decontaminate.contamination(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = {i: decontaminate.Item(i, decontaminate._words([t]).hashes, decontaminate._words([t.split(". ")[-1]]).hashes) for i, t in items}
    there, missed = 0, 0
    for i, text in rows:
        words, item = decontaminate._words([text]).hashes, known[i]
        n = len(item.words)
        if n and any(item.found(words[a:a + n]) for a in range(max(1, len(words) - n + 1))):
            there += 1
            missed += i not in found[i]
        for other in found[i]:
            assert decontaminate.common_subsequence(known[other].words, words) >= 0.75 * len(known[other].words)
    assert there > 100 and missed <= 0.1 * there


def test_nothing_but_the_latent_search_leads_to_leaks(spark, monkeypatch):
    items, rows = _items_and_hosts(60, 0.0)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(docs, benchmark).filter("contaminated").count() == 60
    monkeypatch.setattr(decontaminate, "COSINE", 2.0)
    monkeypatch.setattr(decontaminate, "SHORT_COSINE", 2.0)
    assert decontaminate.contamination(docs, benchmark).filter("contaminated").count() == 0


def test_centres_differ_and_lie_in_the_largest_component(spark):
    """Nodes 0 to 4 are alone, the others linked; all share the same 20 buckets."""
    rows = [(bucket, node, min(node, 5)) for bucket in range(20) for node in range(50)]
    rooted = spark.createDataFrame(rows, "bucket long, node long, root long")
    spans = near_copies._spans(rooted)
    assert sorted(r["bucket"] for r in spans.collect()) == list(range(20))
    pairs = {(r["a"], r["b"]) for r in near_copies._stars(rooted, spans).collect()}
    assert {b for _, b in pairs} == set(range(5)) and min(a for a, _ in pairs) >= 5 and len({a for a, _ in pairs}) > 5


def test_documents_of_terms():
    draw = np.random.default_rng(6)
    sizes = [0, 3, 500, 0, 40, 0]
    terms = draw.integers(0, 30, sum(sizes)) * 1000
    want = np.zeros(decontaminate.BUCKETS, dtype=np.int64)
    for part in np.split(terms, np.cumsum(sizes)[:-1]):
        want[np.unique(part)] += 1
    assert (decontaminate._documents_of_terms(terms, np.array(sizes)) == want).all()
    assert not decontaminate._documents_of_terms(terms[:0], np.array([0, 0])).any()


def test_latent_spaces_hold_the_items_terms_only(spark):
    texts = ["one two three four", "three four five", "six seven eight nine ten"]
    words = [decontaminate._terms(decontaminate._words([t]).hashes) for t in texts]
    used, idf = np.unique(np.concatenate(words)), np.linspace(1, 2, decontaminate.BUCKETS)
    passages = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (1, texts[2])], "space long, text string")
    spaces = decontaminate.latent_spaces(passages, idf, used, 2, 2)
    assert [s.shape for s in spaces] == [(len(used), 2), (len(used), 1)]
    for terms, space in zip(words, (spaces[0], spaces[0], spaces[1])):
        vector = np.zeros(len(used))
        np.add.at(vector, np.searchsorted(used, terms), idf[terms])
        # All of an item lies in its space.
        assert np.allclose(space @ (space.T @ vector), vector)
