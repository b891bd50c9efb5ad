"""The operators against brute force, the tokenizer libraries and planted cases, on awkward rows."""
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
import corpus_pipeline
from filestrata.llm import (byte_bpe, catalog, components, decontaminate, dom, lattice, lattice_lm, licences, main_text, near_copies,
                            private_data, quality_rules, token_counts, toxicity)

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \t\n", "one", "a b c d", "x " * 3000, "Ünï 日本語 😀 <|endoftext|> 'll   \n\n d", "a\x00b\x1c c", "same text of six words here", "same text of six words here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "text", None) for i, t in enumerate(ODD)] + [(None, "a row without an id", None, 1), (3, "an id that repeats", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, member long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def _texts(spark, folder=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_byte_bpe_equals_the_library(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = [t or "" for t in ODD] + list(_texts(spark).values())[:80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_bpe.round_trip(docs, path).collect():
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back} == {i: t.encode() for i, t in enumerate(texts)}
    assert byte_bpe.round_trip(odd, path).count() == odd.count() and byte_bpe.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(24, 4), (64, 32), (65536, 512)])
def test_token_counts_equal_the_library(chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    draw = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(draw.choice(["a", "é", " ", "  ", "\n", "1", "'s", "<|endoftext|>", "日", "th", "　"]) for _ in range(300)) for _ in range(60)]
    want = [len(x.ids) for x in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.Counter(path)
    assert counter.whole(texts) == want
    assert [counter.spliced(t, chunk, overlap)[0] for t in texts] == want


def test_token_counts_of_rows(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.token_counts(odd, path, chunk=100, overlap=8).collect()
    assert len(rows) == odd.count() and all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert any(r["n_chunks"] > 1 for r in rows) and token_counts.token_counts(empty, path).count() == 0


def _words(text, lower=True):
    table = {c: c + 32 for c in range(65, 91)} if lower else {}
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))


def _shingles(text):
    w = _words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _brute_components(texts):
    sets, root = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, sets


def _family(draw, n, edits):
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_copies_equal_brute_force(spark, monkeypatch):
    draw = random.Random(11)
    listed = _family(draw, 60, 7) + _family(draw, 60, 3) + _family(draw, 1, 0) * 9 + [t for t in ODD if t is not None] + list(_texts(spark).values())[:60]
    texts = dict(enumerate(listed))
    monkeypatch.setattr(near_copies, "PAIRWISE", 8)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    want, sets = _brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_copies.near_copies(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in rows)


def test_near_copies_of_odd_rows(odd, empty):
    rows = near_copies.near_copies(odd).collect()
    assert len(rows) == odd.count() and near_copies.near_copies(empty).count() == 0
    assert [r["component_id"] for r in rows if r["doc_id"] == 9] == [8]
    assert near_copies.one_of_each(odd).columns == odd.columns


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (7, 7), (70, None)], "a long, b long")
    assert dict(components.components(edges).collect()) == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50}


def test_quality_counts_and_keeps(spark, odd, empty):
    texts = _texts(spark)
    rows = {r["doc_id"]: r for r in quality_rules.op10_quality_rules(spark, SF).collect()}
    for i, t in texts.items():
        w, r = _words(t, lower=False), rows[i]
        runs = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if runs[tuple(w[k:k + 5])] > 1 for j in range(5)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if _words(line):
                again += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in labels if labels[i] == 1 and not rows[i]["base_failed"]]
    assert np.mean([rows[i]["kept"] for i in good]) > 0.95
    assert quality_rules.judged(odd).count() == odd.count() and quality_rules.judged(empty).count() == 0


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rows = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    pairs = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    wins = [(a > b) + 0.5 * (a == b) for a, x in pairs if x for b, y in pairs if not y]
    assert np.mean(wins) > 0.9
    model = toxicity.Model(0.01, -4.0, {"bad": 8.0})
    found = {r["doc_id"]: r for r in toxicity.score(odd.withColumn("text", F.concat("text", F.lit(". So BAD! ok"))), model).collect()}
    assert found[3]["score"] > 0.9 and found[1]["score"] == pytest.approx(0.01)
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, none).count() == odd.count()


def test_lattice_sums_over_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    log_p = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1)))

    def paths(word):
        if not word:
            yield []
            return
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                yield from ([pieces.index(word[:n])] + rest for rest in paths(word[n:]))
        if word[0] not in pieces:
            yield from ([-1] * len(word[0].encode()) + rest for rest in paths(word[1:]))

    words, counts = ["", "a", "ab", "abab", "bbé", "aaabba", "日a"], np.arange(1, 8.0)
    total, expected = lattice.Lattice(pieces).log_probabilities(words, log_p, counts)
    by_hand, pieces_by_hand = [], np.zeros(len(log_p))
    for word, n in zip(words, counts):
        scored = [(sum(log_p[i] for i in path), path) for path in paths("▁" + word)]
        by_hand.append(np.logaddexp.reduce([s for s, _ in scored]))
        for s, path in scored:
            for i in path:
                pieces_by_hand[i] += n * math.exp(s - by_hand[-1])
    assert np.allclose(total, by_hand) and np.allclose(expected, pieces_by_hand)


def test_lm_base_scores(spark, odd, empty):
    rows = lattice_lm.op8_lattice_lm(spark, SF).collect()
    tokens = {i: _words(t) + [None] for i, t in _texts(spark).items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert -math.inf < r["score"] < 0
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert lattice_lm.lm_scores(odd, F.lit(True), path).count() == odd.count()
    assert lattice_lm.lm_scores(odd, F.lit(False), path).count() == odd.count()
    assert lattice_lm.lm_scores(empty, F.lit(True), path).count() == 0


def test_lm_scores_words_below_any_double(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, log_p = lattice_lm.vocabulary(path)
    at, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))

    def by_hand(word):
        ahead = [0.0]
        for j in range(1, len(word) + 1):
            runs = [(i, at[word[i:j]]) for i in range(max(0, j - longest), j) if word[i:j] in at]
            edges = [ahead[i] + log_p[piece] for i, piece in runs]
            if word[j - 1] not in at:
                edges.append(ahead[j - 1] + len(word[j - 1].encode()) * log_p[-1])
            ahead.append(np.logaddexp.reduce(edges))
        return ahead[-1]

    draw = random.Random(8)
    unseen = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=1000)), "".join(chr(0x4E00 + draw.randrange(20_000)) for _ in range(100)), "short"]
    train = ["alpha beta beta gamma", "alpha delta"]
    docs = spark.createDataFrame(list(enumerate(unseen + [" ".join(unseen * 2)] + train)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in lattice_lm.lm_scores(docs, F.col("doc_id") >= 4, path, rounds=0).collect()}
    # Six words of four kinds, two of them once and two of them twice; two ends.
    p_end, discount = 3 / 10, 3 / 8
    words = [(by_hand("▁" + w) + math.log((1 - p_end) / 6 * discount * 4)) / math.log(10) for w in unseen]
    assert min(words) < -400
    for i, want in enumerate([*words, 2 * sum(words)]):
        assert scores[i] == pytest.approx(want + math.log10(p_end))


def test_main_text_of_given_and_odd_pages(spark):
    rows = {r["page_id"]: r["text"] for r in main_text.op9_main_text(spark, SF).collect()}
    exact = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        import html
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        exact += rows[r["page_id"]] == "\n".join(b for b in blocks if b)
    assert exact >= 0.95 * len(rows)
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (3, "u", "<div><p>un<closed", 3), (3, "u", "<" * 500 + "<b>" * 500, 4)],
                                  "page_id long, url string, html string, text long")
    assert main_text.main_text(pages).count() == 4 and main_text.main_text(pages.limit(0)).count() == 0


def test_main_text_on_drawn_pages():
    trees, draw, shares = main_text.trained(200), random.Random(99), []
    for _ in range(100):
        page = dom.Page(main_text.drawn_page(draw))
        inside = np.zeros(len(page.tags), dtype=bool)
        for i in range(len(page.tags)):
            inside[i] = page.marks[i] == "1" or page.marks[i] == "" and i > 0 and inside[page.parents[i]]
        want = {t for n, t in page.runs if inside[n]}
        got = set(main_text.decoded(page, trees.odds(page.features())).split("\n"))
        shares.append(len(want & got) / max(1, len(want | got)))
    assert np.mean(shares) > 0.9


def test_decontamination_finds_planted_items(spark, odd, empty):
    draw = random.Random(3)
    items = [(i, " ".join(f"t{draw.randrange(4000)}" for _ in range(n))) for i, n in enumerate([12, 18, 30, 45, 60, 100] * 5)] + [(90, None), (91, ""), (92, "tiny item")]
    fill = lambda n: " ".join(f"t{draw.randrange(4000)}" for _ in range(n))
    rows, want = [], {}
    for i, text in items[:30]:
        words = text.upper().split()
        for _ in range(len(words) // 10):
            words[draw.randrange(1, len(words))] = "zzz"
        rows += [(2 * i, f"{fill(150)} {'!! '.join(words)} {fill(80)}"), (2 * i + 1, fill(300))]
        want[2 * i] = [i]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, benchmark).collect() if r["contaminated"]}
    assert found == want
    assert decontaminate.contamination(odd, benchmark).count() == odd.count()
    assert decontaminate.contamination(empty, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("n_items,least,most", [(2_000, 15, 63), (10_000, 15, 63), (500, 3, 8)])
def test_decontamination_finds_every_verbatim_item(spark, n_items, least, most):
    draw = random.Random(n_items)
    texts = [t.split() for t in _texts(spark, "/root/testdata/sf0.01").values() if t and len(t.split()) > 80]
    items, rows = [], []
    for i in range(n_items):
        words, n = draw.choice(texts), draw.randint(least, most)
        at = draw.randrange(len(words) - n)
        items.append((i, " ".join(words[at:at + n])))
    for i, item in items[:1_000]:
        host = draw.choice(texts)[:400]
        at = draw.randrange(len(host))
        rows.append((i, " ".join([*host[:at], item, *host[at:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark).filter("contaminated AND array_contains(items, doc_id)").select("doc_id")
    assert not {i for i, item in items[:1_000] if re.search(r"\w", item)} - {r["doc_id"] for r in found.collect()}


def test_common_subsequence_and_classes():
    a, b = np.array([1, 2, 3, 2, 5]), np.array([2, 9, 3, 5, 1])
    assert decontaminate.common_subsequence(a, b) == 3 and decontaminate.common_subsequence(a, a) == 5
    assert [decontaminate.length_class(n) for n in (1, 9, 16, 17, 25, 33, 49, 65)] == [8, 12, 16, 24, 32, 48, 64, 96]


@pytest.mark.parametrize("expanded", [7, 4_000_000])
@pytest.mark.parametrize("cells", [6, 23])
def test_bound_on_an_items_words_is_never_too_low(monkeypatch, cells, expanded):
    monkeypatch.setattr(decontaminate, "_CELLS", cells)
    monkeypatch.setattr(decontaminate, "_EXPANDED", expanded)
    draw = np.random.default_rng(5)
    items = [decontaminate.Item(i, draw.integers(0, 40, n).astype(np.uint64) << decontaminate._SHIFT, np.zeros(0, dtype=np.uint64))
             for i, n in enumerate((3, 12, 20, 30, 40))]
    index = decontaminate.Index.of(items, np.ones(decontaminate.BUCKETS), draw.standard_normal((decontaminate.BUCKETS, 4)))
    in_order = [item for _, _, members, _ in index.classes for item in members]
    terms = draw.integers(0, 60, 200)
    last, before = {}, []
    for i, term in enumerate(terms.tolist()):
        before.append(last.get(term, -1))
        last[term] = i
    item, start = draw.integers(0, len(items), 300), draw.integers(0, 200, 300)
    stop = np.minimum(200, start + draw.integers(0, 30, 300))
    bound = index._at_most(item, terms, np.array(before), start, stop)
    for k, (i, a, b) in enumerate(zip(item.tolist(), start.tolist(), stop.tolist())):
        there = set(terms[a:b].tolist())
        want = sum(x in there for x in decontaminate._terms(in_order[i].words).tolist())
        assert bound[k] == want if cells == 23 else bound[k] >= want
    assert not len(index._at_most(item[:0], terms, np.array(before), start[:0], stop[:0]))


def test_surrogates(spark, odd, empty):
    text = "Mr. John Smith met Mrs. Anna Smith at +1 (017) 555-7713 or +1 017 555 7713, 4785380592391139; A.B@X.COM a.b@x.com 152.143.123.131."
    docs = spark.createDataFrame([(i, text, 7) for i in range(3)] + [(9, "nothing here", 7)], "doc_id long, text string, mark long")
    rows = private_data.with_surrogates(docs).collect()
    new = {r["text"] for r in rows if r["doc_id"] < 3}
    assert len(rows) == 4 and len(new) == 1
    out = new.pop()
    for secret in ("John", "Anna", "Smith", "555-7713", "555 7713", "4785380592391139", "A.B@", "a.b@", "152.143"):
        assert secret not in out
    names = re.match(r"Mr\. (\w+an) (\w+son) met Mrs\. (\w+ina) (\w+son) at \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}), \d{16}; (\S+) (\S+) [\d.]+$", out)
    assert names and names[2] == names[4] and names.group(5, 6, 7) == names.group(8, 9, 10) and names[11].lower() == names[12]
    assert [r["text"] for r in rows if r["doc_id"] == 9] == ["nothing here"]
    assert private_data.with_surrogates(odd).count() == odd.count() and private_data.with_surrogates(empty).count() == 0


def test_colliding_surrogates_draw_again(spark):
    ips = spark.createDataFrame([("number", f"{i:03d}") for i in range(0, 1000, 4)], "kind string, canonical string")
    rows = private_data.surrogates(ips).collect()
    assert len({r["surrogate"] for r in rows}) == 250 == len(rows)
    assert not {r["surrogate"] for r in rows} & {r["canonical"] for r in rows}


def test_licences(spark, odd):
    rows = [(100, "He lost his licence plate and asked permission."), (101, "the software comes with a license and a warranty"),
            (102, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!"), (103, None), (104, ""), (104, ""),
            (105, "Licensed under the MIT license (see file).\nThis work is licensed under the GNU General Public License, version 3.")]
    found = {r["doc_id"]: r["families"] for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {100: [], 101: [], 102: ["Apache"], 103: [], 104: [], 105: ["GPL", "MIT"]}


def test_pipeline(spark):
    before, rejected = spark.read.parquet(f"{SF}/documents.parquet"), []
    docs = before
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == before.columns
        rejected.append(docs.count() - out.count())
        docs = out.checkpoint()
    assert all(n > 0 for n in rejected[:3]) and rejected[3] == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_catalog_has_all():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES if n.startswith("op")) == list(range(1, 14))
