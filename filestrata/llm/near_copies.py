"""Near copies by one-permutation hashing with optimal densification, bands and star-shaped candidates.

A document is the set of its distinct word shingles; two are linked if the sets' Jaccard similarity reaches a
threshold. One pass hashes each shingle once, deals the hashes into bins by their top bits and keeps each
bin's smallest; an empty bin borrows from the first non-empty bin on a fixed random tour of its own. Runs of
bins make bands. Documents with equal sets are one class, and only one of them goes on.

Bands are taken in rounds. A band's bucket proposes star edges only, from its centre to every other member, so candidates grow with
the members and not with their square; what a round links is joined before the next, which proposes pairs across components only.
A proposal must pass two narrow checks, the sizes of the sets and the bins in which the signatures agree, before the texts
of both meet; a centre's text travels once per block of its members. Links are confirmed on the full sets.

A star can miss a link between two members that are both unlike the centre. Within one component further links change nothing, so
at last, in each bucket whose members are still in several components, the members outside its largest component
are compared with the members of other components, small buckets whole and large ones in blocks of bounded size. What travels
there is a sample of each set's hashes, the whole set where it is small, and a pair that meets in several buckets is looked at in the first; so
only pairs that are all but linked leave a block. A large bucket in which many members are left is dealt anew by a second band first: two
similar sets agree in several bands, so they still meet, and others part; what moves grows with the members, not with their square.

Only ids, sketches and buckets are stored between rounds, as compressed tables that are deleted when the next one stands.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import fits_broadcast, sized_join, wide_join
from ..session import discard, stored
from . import frames
from .components import components
from .words import Words, mixed, sequence_hash, window_hashes

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Bands of each round.
ROUNDS = (4, 28)
#: Members of a bucket that is compared whole, and members of a block of larger buckets.
PAIRWISE, BLOCK = 64, 256
#: Hashes of a set that its sample holds at most.
SAMPLE = 512
#: Bytes of a table, written as JSON, that is broadcast; several of them are held by the driver at a time.
BROADCAST = 16 << 20
#: Standard errors that signatures may agree less than they should.
ERRORS = 5.0

_RANDOM = np.random.default_rng(20240301)
#: A random tour for each bin, with all bins at its end so that it meets a full one.
_TOURS = np.concatenate([_RANDOM.integers(0, BINS, (BINS, 1024)),
                         (np.arange(BINS)[:, None] + np.arange(BINS)[None, :]) % BINS], axis=1)
_FLOORS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)
_WEIGHTS = _RANDOM.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _RANDOM.integers(1, 2**63, BANDS, dtype=np.uint64)
_KEY_SALT = _RANDOM.integers(1, 2**63, 2, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    words = Words(texts, lower=True)
    windows, first = window_hashes(words.hashes, size), words.first
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(windows[a:b - size + 1]))
        else:
            out.append(np.array([sequence_hash(words.hashes[a:b])] if b > a else [], dtype=np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value per bin of a non-empty sorted set."""
    first = np.searchsorted(hashes, _FLOORS)
    full = np.diff(np.append(first, len(hashes))) > 0
    source = np.arange(BINS)
    left = np.flatnonzero(~full)
    for start, stop in ((0, 8), (8, 64), (64, _TOURS.shape[1])):
        if not len(left):
            break
        met = full[_TOURS[left, start:stop]]
        found = met.any(axis=1)
        source[left[found]] = _TOURS[left[found], start + met.argmax(axis=1)[found]]
        left = left[~found]
    return hashes[first[source]]


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One key per band of a signature; keys of different bands differ."""
    rows = bins.reshape(BANDS, ROWS)
    return mixed((rows * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def promising(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of signatures agree in so many bins that the sets, of the given sizes, may be similar enough.

    With few shingles few bins are full, and agreement tells less; so it has to be within `ERRORS` standard errors of the threshold.
    """
    least, most = np.minimum(n_x, n_y), np.maximum(n_x, n_y)
    full = BINS * -np.expm1(-least / BINS)
    share = percent / 100
    wanted = BINS * (share - ERRORS * np.sqrt(share * (1 - share) / np.maximum(full, 1e-9)))
    return (100 * least >= percent * most) & ((x == y).sum(axis=-1) >= wanted)


def sample(hashes: np.ndarray) -> tuple[int, bytes]:
    """The high halves of a set's hashes; those whose low bits, as many as the first number says, are 0, so that `SAMPLE` are left at most."""
    level, kept = 0, (hashes >> np.uint64(32)).astype(np.uint32)
    while len(kept) > SAMPLE:
        level += 1
        kept = kept[kept & np.uint32((1 << level) - 1) == 0]
    return level, kept.tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id, mark, n_shingles, key1, key2, bands, signature, level, sample`: equal keys mean equal sets; empty sets have no bands.

    `mark` is a hash of the text, which tells rows of one id apart. The signature has the low byte of each bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames.forget()
        for batch in frames.slices(batches, "text"):
            sets = shingle_sets(frames.raw(batch.column("text")))
            keys = [[mixed(s ^ salt).sum(dtype=np.uint64).view(np.int64) for s in sets] for salt in _KEY_SALT]
            rows, samples = [signature(s) if len(s) else None for s in sets], list(map(sample, sets))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"), frames.longs([len(s) for s in sets]), *map(frames.longs, keys),
                pa.array([[] if r is None else band_keys(r) for r in rows], pa.list_(pa.int64())),
                pa.array([b"" if r is None else mixed(r).astype(np.uint8).tobytes() for r in rows], pa.binary()),
                pa.array([x for x, _ in samples], pa.int32()), pa.array([x for _, x in samples], pa.binary()),
            ], ["doc_id", "mark", "n_shingles", "key1", "key2", "bands", "signature", "level", "sample"])

    return frames.texts(docs, _mark()).mapInArrow(
        run, "doc_id long, mark long, n_shingles long, key1 long, key2 long, bands array<long>, signature binary, level int, sample binary")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def _met(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", small: bool | None = None) -> DataFrame:
    return sized_join(rows, table, keys, how, BROADCAST, small)


def _hinted(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table, BROADCAST) else table.hint("merge")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (`a`, `b`) of nodes whose full sets have 100 * intersection >= percent * union.

    Pairs of one `a` are dealt into blocks. Texts meet their pairs where they are read if the pairs are few, and travel once, to their blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames.forget()
        centre, left = None, None
        for batch in frames.slices(batches, "text"):
            of, node, role = (batch.column(c).to_pylist() for c in ("a", "node", "role"))
            found = []
            for i, right in enumerate(shingle_sets(frames.raw(batch.column("text")))):
                if role[i] == 0:
                    centre, left = of[i], right
                elif centre == of[i]:
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if 100 * both >= percent * (len(left) + len(right) - both):
                        found.append((of[i], node[i]))
            yield pa.RecordBatch.from_arrays([frames.longs([x[i] for x in found]) for i in (0, 1)], ["a", "b"])

    # A row of two ids here is a wider row or two below, so what is made of the pairs is measured again.
    small = fits_broadcast(pairs, BROADCAST)
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = _met(pairs, counts, ["a"], small=small).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    wanted = dealt.select("a", "block", F.col("b").alias("node"), F.lit(1).alias("role")).unionByName(
        dealt.select("a", "block").distinct().select("a", "block", F.col("a").alias("node"), F.lit(0).alias("role")))
    wanted = stored(_met(nodes.select("node", "doc_id", "mark"), wanted, ["node"]))
    ids, texts = ["doc_id", "mark"], frames.texts(docs, _mark())
    if fits_broadcast(wanted, BROADCAST):
        texts = texts.join(F.broadcast(wanted), ids)
    else:
        # Of the texts only those that are in a pair are sorted, as far as their ids can be broadcast.
        met = wanted.select(*ids).distinct()
        texts = wide_join(texts.join(F.broadcast(met), ids, "left_semi") if fits_broadcast(met, BROADCAST) else texts, wanted, ids, "inner")
    # Rows that repeat an id and text give the same link again.
    in_blocks = texts.select("a", "block", "node", "role", "text").repartition("a", "block").sortWithinPartitions("a", "block", "role")
    links = stored(in_blocks.mapInArrow(run, "a long, b long"))
    discard(wanted)
    return links


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames.forget()
        for batch in batches:
            x, y = (_matrix(batch.column(c).to_pylist()) for c in ("signature_a", "signature_b"))
            n_x, n_y = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            at = pa.array(np.flatnonzero(promising(x, y, n_x, n_y, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in "ab"], ["a", "b"])

    a, b = (nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}")) for x in "ab")
    if fits_broadcast(pairs, BROADCAST):
        # Few pairs meet the signatures where these are read, for each side by itself.
        met = a.join(F.broadcast(pairs), "a").join(b.join(F.broadcast(pairs), "b"), ["a", "b"])
    else:
        # One centre may be in very many pairs.
        centres = _met(a, pairs.select("a").distinct(), ["a"], "left_semi")
        met = wide_join(wide_join(pairs, b, ["b"], "inner"), centres, ["a"], "inner")
    met = met.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return met.select("a", "b", "n_a", "n_b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype=np.uint8).reshape(-1, BINS)


def _rooted(nodes: DataFrame, roots: DataFrame | None, first: int, bands: int) -> DataFrame:
    """`band, bucket, node, root` of some bands; a node that nothing is linked with is its own root."""
    kept = nodes.select("node", F.slice("bands", first + 1, bands).alias("bands"))
    if roots is None:
        kept = kept.withColumn("root", F.col("node"))
    else:
        kept = _met(kept, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    return kept.select("node", "root", F.posexplode("bands").alias("band", "bucket"))


def _spans(rooted: DataFrame) -> DataFrame:
    """`bucket` of the buckets whose members are in several components."""
    spans = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return stored(spans.filter("low <> high").select("bucket"))


def _stars(rooted: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of each bucket's centre with its members in other components.

    The centre is a member of the bucket's largest component, drawn by hash for each bucket: were it the least node, a group of near copies
    would have the same centre in all of its buckets, and what is unlike that one would be left over.
    """
    members = stored(_met(rooted, spans, ["bucket"]))
    shares = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("bucket", "node")).alias("a"))
    centres = shares.groupBy("bucket").agg(F.max(F.struct("n", F.xxhash64("bucket", "root").alias("draw"), "root", "a")).alias("most")).select(
        "bucket", F.col("most.a").alias("a"), F.col("most.root").alias("of"))
    met = _met(members, centres, ["bucket"]).filter("root <> of")
    out = stored(met.select("a", F.col("node").alias("b")).distinct())
    discard(members)
    return out


def _unlike(rooted: DataFrame) -> DataFrame:
    """Members of buckets that span components, with the bucket's size, its largest component and the rest's size."""
    shares = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    spans = stored(
        shares.groupBy("bucket").agg(F.sum("n").alias("size"), F.max_by("root", "n").alias("main"), F.max("n").alias("most"), F.count("*").alias("parts"))
        .filter("parts > 1").select("bucket", "size", "main", (F.col("size") - F.col("most")).alias("rest")))
    out = stored(_met(rooted, spans, ["bucket"]))
    discard(spans)
    return out


def _dealt_anew(crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of large buckets by their bucket and each later band: `band, second, bucket, node, root`."""
    crowds = crowded.select("node", "root", F.col("band").alias("first"), F.col("bucket").alias("crowd"))
    later = _met(nodes.select("node", "bands"), crowds, ["node"]).select(
        "node", "root", "crowd", "first", F.posexplode(F.expr("slice(bands, first + 2, 64)")).alias("after", "later"))
    return later.select(F.col("first").alias("band"), (F.col("first") + 1 + F.col("after")).alias("second"),
                        F.xxhash64("crowd", "later").alias("bucket"), "node", "root")


def _in_blocks(unlike: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members with their samples, dealt into the blocks in which they meet; `side` tells whether they ask (1), are asked (2) or both (3).

    A node meets its sample once, with the list of its buckets, and is dealt into their blocks after that. The list has an entry for each
    two bands at most, however large the buckets are.
    """
    whole = F.col("size") <= PAIRWISE
    cut = unlike.withColumns({
        "whole": whole, "asks": F.col("root") != F.col("main"),
        "lefts": F.when(whole, 1).otherwise(F.ceil(F.col("rest") / BLOCK)).cast("int"),
        "rights": F.when(whole, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")})
    entry = ["bucket", "band", "second", "root", "main", "whole", "asks", "lefts", "rights"]
    lists = cut.groupBy("node").agg(F.collect_list(F.struct(*entry)).alias("met"))
    sampled = nodes.select("node", "n_shingles", "bands", "level", "sample")
    rows = wide_join(lists, sampled, ["node"], "inner").select("node", "n_shingles", "bands", "level", "sample", F.inline("met"))

    def place(lb: Column, rb: Column, side: Column | int) -> Column:
        return F.struct(lb.alias("lb"), rb.alias("rb"), (F.lit(side) if isinstance(side, int) else side).alias("side"))

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    zero = F.lit(0)
    asked = F.transform(F.sequence(zero, F.col("lefts") - 1), lambda lb: place(lb, own("rights"), 2))
    asking = F.transform(F.sequence(zero, F.col("rights") - 1), lambda rb: place(own("lefts"), rb, 1))
    places = F.when(F.col("whole"), F.array(place(zero, zero, F.when(F.col("asks"), 3).otherwise(2)))).when(
        F.col("asks"), F.concat(asked, asking)).otherwise(asked)
    return rows.select("bucket", "band", "second", "node", "root", "main", "n_shingles", "bands", "level", "sample", F.inline(places))


class _Group:
    """The members that meet in one block."""

    def __init__(self, rows: list[dict], percent: int):
        self.rows, self.percent = rows, percent
        asked = [r for r in rows if r["side"] & 2]
        self.nodes, self.roots, self.n, self.levels = (np.array([r[c] for r in asked]) for c in ("node", "root", "n_shingles", "level"))
        self.bands = np.array([r["bands"] for r in asked], dtype=np.int64).reshape(len(asked), BANDS)
        self.samples = [np.frombuffer(r["sample"], dtype=np.uint32) for r in asked]

    def pairs(self) -> list[tuple[int, int]]:
        if not len(self.nodes):
            return []
        return [(min(row["node"], other), max(row["node"], other))
                for row in self.rows if row["side"] & 1 for other in self.nodes[self._fit(row)].tolist()]

    def _fit(self, row: dict) -> np.ndarray:
        """The members that a row may be linked with: of other components, similar in size, and met here first."""
        fit = (self.roots != row["root"]) & ((self.roots == row["main"]) | (self.nodes > row["node"]))
        fit &= 100 * np.minimum(self.n, row["n_shingles"]) >= self.percent * np.maximum(self.n, row["n_shingles"])
        at = np.flatnonzero(fit)
        if len(at):
            same = self.bands[at] == np.array(row["bands"], dtype=np.int64)
            first = same.argmax(axis=1) == row["band"]
            if row["second"] >= 0:
                same[:, row["band"]] = False
                first &= same.argmax(axis=1) == row["second"]
            at = at[first]
        return at[self._similar(row, at)] if len(at) else at

    def _similar(self, row: dict, at: np.ndarray) -> np.ndarray:
        mine = np.frombuffer(row["sample"], dtype=np.uint32)
        sizes = np.array([len(self.samples[i]) for i in at])
        theirs = np.concatenate([self.samples[i] for i in at])
        level = np.maximum(self.levels[at], row["level"])
        mask = (np.left_shift(1, level) - 1).astype(np.uint32)
        counted = theirs & np.repeat(mask, sizes) == 0
        hit = counted & (mine[np.minimum(np.searchsorted(mine, theirs), max(len(mine) - 1, 0))] == theirs if len(mine) else False)
        # Samples hold one hash at least where sets are small; a run may be empty, which reduceat cannot add.
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        both, n_theirs = (np.diff(np.concatenate(([0], np.cumsum(x)))[bounds]) for x in (hit, counted))
        n_mine = np.array([np.count_nonzero(mine & m == 0) for m in np.unique(mask)])[np.searchsorted(np.unique(mask), mask)]
        share = self.percent / 100
        slack = np.where(level == 0, 0.02, ERRORS * np.sqrt(share * (1 - share) / np.maximum(np.minimum(n_mine, n_theirs), 1)))
        return both >= (share - slack) * (n_mine + n_theirs - both)


def _meeting(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (`a`, `b`) across components whose samples all but link them; a block is held by one task at a time, and is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames.forget()
        key, rows = None, []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                of = row["bucket"], row["lb"], row["rb"], row["second"]
                if of != key:
                    found += _Group(rows, percent).pairs()
                    key, rows = of, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([frames.longs([x[i] for x in found]) for i in (0, 1)], ["a", "b"])
        found = _Group(rows, percent).pairs()
        yield pa.RecordBatch.from_arrays([frames.longs([x[i] for x in found]) for i in (0, 1)], ["a", "b"])

    keys = ["bucket", "lb", "rb", "second"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _leftovers(nodes: DataFrame, roots: DataFrame | None, spans: list[DataFrame], percent: int) -> DataFrame:
    """Pairs across components that share a bucket and may be linked; only buckets that spanned components before can do so now.

    Of the bands that two sets share, the first one's bucket is either not crowded or dealt anew with the others.
    """
    buckets = reduce(DataFrame.unionByName, [x.select("bucket") for x in spans])
    rooted = stored(_rooted(nodes, roots, 0, BANDS).join(_hinted(buckets), "bucket", "left_semi").withColumn("second", F.lit(-1)))
    unlike = _unlike(rooted)
    crowded = (F.col("size") > PAIRWISE) & (F.col("rest") > BLOCK)
    again = _unlike(_dealt_anew(unlike.filter(crowded), nodes))
    blocks = _in_blocks(unlike.filter(~crowded), nodes).unionByName(_in_blocks(again, nodes))
    out = stored(_meeting(blocks, percent).distinct())
    discard(rooted, unlike, again)
    return out


def linked(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """`node, root` of the classes that have links; `nodes` has a sketch of each class, and `docs` the texts by id."""
    roots, first, spans = None, 0, []
    for bands in (*ROUNDS, None):
        if bands is None:
            pairs = _leftovers(nodes, roots, spans, percent)
        else:
            rooted = _rooted(nodes, roots, first, bands)
            spans.append(_spans(rooted))
            proposed = _stars(rooted, spans[-1])
            pairs, first = stored(_likely(proposed, nodes, percent)), first + bands
            discard(proposed)
        if pairs.take(1):
            found = confirmed(pairs, nodes, docs, percent)
            # Roots stand for all that was linked before.
            edges = found if roots is None else found.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
            old, roots = roots, components(edges, BROADCAST)
            discard(found, *([] if old is None else [old]))
        discard(pairs)
    discard(*spans)
    return roots


def near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` of each document.

    `component_id` is the smallest id that links lead to, `kept` tells whether it is the document's own. Null and
    empty texts are linked with nothing. A null id is left alone: its component is null and it stays. Each row counts for its own
    text; rows that repeat an id with different texts may be in different components.
    """
    return _judged(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of `near_copies` with their `mark` and, if they have an id and words, the `root` of their component."""
    sketched = stored(sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    keys = ["key1", "key2", "n_shingles"]
    filled = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Of a class the row with the least id, and of its rows one, stands for all.
    classes = stored(filled.groupBy(*keys).agg(F.min(F.struct("doc_id", "row")).alias("least")).select(
        *keys, F.col("least.row").alias("node"), F.col("least.doc_id").alias("first_id")))
    nodes = stored(_met(filled.withColumnRenamed("row", "node"), classes.select("node"), ["node"], "left_semi").select(
        "node", "doc_id", "mark", "n_shingles", "bands", "signature", "level", "sample"))
    roots = linked(nodes, docs, percent)
    if roots is None:
        component = classes.select(*keys, F.col("first_id").alias("component_id"), F.col("node").alias("root"))
    else:
        rooted = _met(classes, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
        ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        component = _met(rooted, ids, ["root"]).select(*keys, "component_id", "root")
    component = stored(component)
    discard(nodes, classes, *([] if roots is None else [roots]))
    found = _met(sketched.select("doc_id", "mark", *keys), component, keys, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "mark", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
                        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy component of every document."""
    return near_copies(frames.table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.root, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(l.root, w.doc_id) AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.a = w.doc_id
"""


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component, and all rows that have no id or no words.

    That is a row of the component's smallest id; of several rows of that id the one whose text has the least hash, and of rows that
    repeat id and text one. Rows that repeat an id with texts that are not linked all stay.
    """
    judged = stored(_judged(docs, percent).filter("root IS NOT NULL").select("doc_id", "mark", "root"))
    least = judged.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("least"))
    rest = _met(judged, least, ["root"]).filter(F.struct("doc_id", "mark") != F.col("least"))
    drop = stored(rest.select(F.col("doc_id").alias("_near_id"), F.col("mark").alias("_near_mark")).distinct())
    same = stored(judged.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("doc_id").alias("_near_id"), F.col("mark").alias("_near_mark")))
    met = (F.col("doc_id") == F.col("_near_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_near_mark"))
    out = docs.join(_hinted(drop), met, "left_anti")
    if same.take(1):
        once = out.join(_hinted(same), met, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(_hinted(same), met, "left_anti").unionByName(once)
    return out.select(*docs.columns)
