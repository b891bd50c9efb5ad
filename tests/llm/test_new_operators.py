"""Language identification, alignment and fill-in-the-middle against brute force, the libraries and held-out accuracy."""
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import compare
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from filestrata.llm import alignment, fill_middle, language

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " \t\n", "one", "a ", " a", "a  b", "x " * 3000, "Ünï 日本語 😀 <|endoftext|> 'll   \n\n d <s> <unk> <0x41>", "a\x00b\x1c c", "tab▁x",
       "a   ", "　  é é ", "A" * 3000 + "   ", "a\r\n b\r", "x\n\n  y\t z", "<P> in it", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "text", None, "en") for i, t in enumerate(ODD)] + [(None, "a row without an id", None, 1, None), (3, "an id that repeats", "x", 2, "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, row long, lang string")


@pytest.fixture(scope="module")
def mixed_texts(spark):
    draw = random.Random(3)
    parts = ["a", "é", " ", "  ", "\n", "\t", "1", "'s", "<s>", "日", "th", "　", "ing", "tion", "\r"]
    return [t for t in ODD if t is None or len(t) < 4000] + ["".join(draw.choice(parts) for _ in range(120)) for _ in range(30)] + [
        r["text"][:1500] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]


def _brute_alignments(texts):
    byte_level = tokenizers.Tokenizer.from_file(BYTES)
    byte_level.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    stands_for = alignment.ByteSide(BYTES).bytes
    rows, links = [], Counter()
    for text in texts:
        a, b = (byte_level.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)) if text else ([], [])
        a_bytes = [stands_for[i] for i in a]
        b_bytes = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append(None)
            continue
        of_a, of_b = ([i for i, token in enumerate(side) for _ in token] for side in (a_bytes, b_bytes))
        linked = sorted(set(zip(of_a, of_b)))
        links.update((a[i], b[j]) for i, j in linked)
        ends_a, ends_b = (np.cumsum(list(map(len, side))) for side in (a_bytes, b_bytes))
        groups, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append([[i for i, e in zip(ids, ends) if low < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))])
            low = end
        rows.append((a, b, groups, linked))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, row in enumerate(rows):
        if row is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, groups, linked = row
        counts = [(links[a[x], b[y]], best[b[y]]) for x, y in linked]
        written = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        out.append((i, len(a), len(b), len(groups), len(linked), sum(n == m for n, m in counts), sum(n for n, _ in counts),
                    hashlib.sha256(written.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups)))
    return out, rows


@pytest.mark.parametrize("heavy,most,block,kept", [(1 << 20, 1 << 21, 1 << 17, 1 << 20), (50, 40, 16, 200), (1, 1, 1, 0)])
def test_alignment_equals_brute_force(spark, monkeypatch, mixed_texts, heavy, most, block, kept):
    for name, value in (("PRODUCTS", most), ("BLOCK", block), ("KEPT", kept)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string")
    got = alignment.aligned_documents(docs, BYTES, PIECES, heavy).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
    assert sorted(map(tuple, got.collect())) == _brute_alignments(mixed_texts)[0]


def test_links_equal_brute_force(spark, mixed_texts):
    docs = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string")
    rows = _brute_alignments(mixed_texts)[1]
    found = alignment.links(docs, BYTES, PIECES).collect()
    assert sorted((r["doc_id"], r["a"], r["b"], r["a_id"], r["b_id"]) for r in found) == sorted(
        (i, x, y, row[0][x], row[1][y]) for i, row in enumerate(rows) if row for x, y in row[3])
    assert sum(r["shared"] for r in found) == sum(len((" " + t).encode()) for t, row in zip(mixed_texts, rows) if row)
    shared = alignment.links(docs, BYTES, PIECES, by="groups")
    assert shared.count() == sum(len(x) * len(y) for row in rows if row for x, y in row[2])


def test_products_equal_dense_ones():
    draw = np.random.default_rng(5)
    for most in (1, 7, 1000):
        a, b = ((draw.random(shape) < 0.3) * draw.integers(1, 5, shape) for shape in ((13, 9), (9, 11)))

        def sparse(m):
            rows, columns = m.nonzero()
            return alignment.Csr(np.searchsorted(rows, np.arange(len(m) + 1)), columns, m[rows, columns], m.shape[1])

        out = np.zeros((13, 11), dtype=int)
        for rows, columns, values in alignment.products(sparse(a), sparse(b), most):
            out[rows, columns] = values
        assert (out == a @ b).all()
        assert (alignment.transposed(sparse(a)).indices == a.T.nonzero()[1]).all()


def test_alignment_on_awkward_rows(odd):
    rows = alignment.aligned_documents(odd, BYTES, PIECES).collect()
    assert len(rows) == odd.count() and "output" not in rows[0]
    same = [r for r in rows if r["doc_id"] in (17, 18)]
    assert len({(r["groups_sha256"], r["count_sum"]) for r in same}) == 1 and all(r["count_sum"] >= 2 * r["n_links"] for r in same)
    assert alignment.aligned_documents(odd.limit(0), BYTES, PIECES).count() == 0


def _brute_cut(key, text, seed=1):
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force(spark, odd, mixed_texts):
    texts = mixed_texts + ["<" * 40 + "S>P>M" * 9, "w" * 5000 + " ab" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    rows = fill_middle.restored(fill_middle.transformed(docs)).collect()
    assert len(rows) == 2 * len(texts) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == _brute_cut(r["doc_id"], text)
        assert r["restored"] == text
    got = fill_middle.restored(fill_middle.transformed(odd)).collect()
    assert len(got) == odd.count() and {r["form"] for r in got if r["doc_id"] is None} == {_brute_cut("", "a row without an id")[1]}
    assert fill_middle.transformed(odd.limit(0)).count() == 0
    strange = spark.createDataFrame([("x", "other"), (None, "psm"), ("x", None)], "output string, form string")
    assert [r["restored"] for r in fill_middle.restored(strange).collect()] == [None] * 3


def test_rank_index_is_exact_and_bounded():
    draw = random.Random(9)
    for epsilon in (1, 8, fill_middle.EPSILON):
        for _ in range(6):
            text = "".join(draw.choice(["a" * draw.randint(1, 400), " ", "1", "é", "Zb"]) for _ in range(draw.randint(0, 3000)))
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
            known = fill_middle.boundaries(text)
            assert known.tolist() == np.cumsum([0, *map(len, units)]).tolist()
            index, ranks = fill_middle.fitted(known, epsilon), np.arange(len(known))
            assert (index.offset(ranks) == known).all()
            assert (np.abs(known - index.predicted(ranks)) <= epsilon + 1).all()
    assert len(fill_middle.fitted(np.arange(0, 90_000, 3)).starts) == 1


def _letters(text):
    """Words by the letters' definition, character by character."""
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            run += low if c.isalpha() and len(low) == 1 else c
        else:
            if any(x.isalpha() for x in run):
                out.append(run)
            run = ""
    return out


def _brute_language(train, texts, postings):
    langs = sorted({lang for _, lang in train if _ and lang and _letters(_)})
    counts = {(lang, k): Counter() for lang in langs for k in (0, *language.ORDERS)}

    def ngrams(word, k):
        padded = f" {word} "
        return [g for g in (padded[i:i + k] for i in range(len(padded) - k + 1)) if g != " "]

    for text, lang in train:
        for word in _letters(text) if lang else []:
            counts[lang, 0][word] += 1
            for k in language.ORDERS:
                counts[lang, k].update(ngrams(word, k))
    floor = max(len(langs), 1) / postings
    share = {key: {x: n / c.total() for x, n in c.items() if n / c.total() >= floor} for key, c in counts.items()}

    def logs(k, x):
        if not any(x in share[lang, k] for lang in langs):
            return None
        return [math.log(share[lang, k].get(x, floor / 2)) for lang in langs]

    def scored(word):
        if (found := logs(0, word)) is not None:
            return found
        for k in language.ORDERS:
            if found := [x for x in (logs(k, g) for g in ngrams(word, k)) if x is not None]:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        words = _letters(text)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        sums = [sum(x) for x in zip(*map(scored, words))]
        top = max(sums)
        out.append((langs[min(i for i, x in enumerate(sums) if x > top - 1e-9)], 1 / sum(math.exp(x - top) for x in sums)))
    return out


@pytest.mark.parametrize("postings,piece", [(1 << 20, 1 << 20), (600, 300), (40, 50)])
def test_language_equals_brute_force(spark, monkeypatch, postings, piece):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    train = [(r["text"][:400], r["lang"]) for r in rows[:40]] + [(None, "en"), ("nobody's", None), ("", "xx"), ("12 34", "yy"), ("ΑΒΓ αβγ", "el")]
    texts = [r["text"][:300] for r in rows] + ODD[:16] + ["zzqx", "αβδ İSTANBUL été", "́́", "ª 123", "日本語 текст"]
    labelled = spark.createDataFrame(train, "text string, lang string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = language.pieces
    monkeypatch.setattr(language, "pieces", lambda texts: cut(texts, piece))
    got = sorted(map(tuple, language.identified(docs, language.fitted(labelled, postings)).collect()))
    want = _brute_language(train, texts, postings)
    assert [x[1] for x in got] == [x[0] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[1] for x in want], abs=1e-6)


def test_language_model_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fitted(docs, 500)
    assert all(sum(len(h) for h, _ in tables) <= 500 for tables in model.known.values()) and model.langs == ["de", "en", "es", "fr"]


def test_language_of_held_out_documents(spark):
    got = language.op11_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_on_awkward_rows(spark, odd):
    model = language.fitted(odd)
    rows = language.identified(odd, model, F.col("row")).collect()
    assert len(rows) == odd.count() and model.langs == ["en", "fr"]
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (0, 1, 2))
    nothing = language.fitted(odd.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language.identified(odd, nothing).collect()} == {("und", 0.0)}
    assert language.identified(odd.limit(0), model).count() == 0


def test_pieces_hold_whole_words():
    text = "word " * 100 + "x" * 300 + " end"
    for limit in (7, 50, 10_000):
        found = [(int(i), part) for of, held in language.pieces(["", text, "ab", text], limit) for i, part in zip(of, held)]
        assert ["".join(p for j, p in found if j == i) for i in range(4)] == ["", text, "ab", text]
        assert all(p.endswith(" ") or p.endswith("end") or p == "ab" for _, p in found)


def test_fill_middle_matches_sql(spark):
    names, rows = compare.spark_rows(fill_middle.op13_fill_middle(spark, SF))
    expected_names, expected = compare.sql_rows(compare.duck(SF), fill_middle.OP13_SQL)
    assert names == expected_names and rows == expected, compare.first_difference(rows, expected)
