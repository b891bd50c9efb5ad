"""Token dictionaries: the most frequent words of a project, and their substitution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text
from ..session import frozen, spread
from .joins import lookup_join
from .numbering import number_rows

BUCKETS = 64
_POSITION_BITS = 28  # 2**28 words per file, 2**35 files per project


def _words(content: Column, pattern: str, sample_chars: int | None) -> Column:
    sample = content if sample_chars is None else F.substring(content, 1, sample_chars)
    return F.regexp_extract_all(sample, F.lit(pattern), F.lit(0))


def token_dictionary(texts: DataFrame, size: int = 256, pattern: str = fixed.CAPSULE_WORD,
                     order: list[str] = ("path",), sample_chars: int | None = None) -> DataFrame:
    """Top ``size`` words per project as (project_id, rank, token, word, n).

    ``texts`` is (project_id, *order, content). Equal counts rank by first occurrence in the
    order of the files. The files are numbered first, from their names alone, so that a place in
    the project is one long: counting then needs one pass over the texts with fixed-width
    counters, combined before the shuffle. The numbers meet the texts in a hash join that moves
    each text once, which is small beside cutting it into words, and spreads them evenly.
    ``sample_chars`` limits the text read per file; by default whole texts count.
    """
    keys = ["project_id", *order]
    listing = frozen(texts.select(*keys))
    numbers = number_rows(listing, ["project_id"], list(order), "_file", "_files").drop("_files")
    placed = spread(texts.select(*keys, "content"), *keys).join(numbers.hint("shuffle_hash"), keys)
    found = _words(F.col("content"), pattern, sample_chars)
    place = F.col("_file") * (1 << _POSITION_BITS) + F.col("_pos")
    counts = (
        placed.select("project_id", "_file", F.posexplode(found).alias("_pos", "word"))
        .groupBy("project_id", "word").agg(F.count("*").alias("n"), F.min(place).alias("_first"))
    )
    ranked = Window.partitionBy("project_id").orderBy(F.desc("n"), "_first")
    return (
        counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= size)
        .select("project_id", "rank", F.concat(F.lit("§"), F.col("rank").cast("string")).alias("token"),
                "word", "n")
    )


def _shelves(dictionary: DataFrame) -> DataFrame:
    """Per project, an array of small word-to-token maps addressed by the word's hash.

    Map lookups scan their entries, so one map per hash bucket keeps a lookup short.
    """
    entry = F.struct(_bucket(F.col("word")).alias("bucket"), F.col("word"), F.col("token"))
    packed = dictionary.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    shelves = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.map_from_entries(F.transform(
            F.filter("entries", lambda e: e["bucket"] == b),
            lambda e: F.struct(e["word"], e["token"]))),
    )
    return packed.select("project_id", shelves.alias("_shelves"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _token_of(word: Column) -> Column:
    return F.try_element_at(F.get("_shelves", _bucket(word)), word)


def substitute(texts: DataFrame, dictionary: DataFrame, spread_by: list[str] = ("path",)) -> DataFrame:
    """Replace whole words by tokens; adds ``payload``, ``tokens_used`` and the ``n_replaced`` runs.

    The dictionary holds a bounded number of words per project; the texts of a large project
    meet it in many tasks.
    """
    runs = text.tokens(F.col("content"))
    tokens = F.transform(runs, _token_of)
    met = F.filter("_tokens", lambda token: token.isNotNull())
    swapped = F.zip_with("_tokens", runs, lambda token, run: F.coalesce(token, run))
    joined = lookup_join(texts, frozen(_shelves(dictionary)), ["project_id"],
                         ["project_id", *spread_by])
    known = F.col("_shelves").isNotNull()
    return joined.withColumn("_tokens", tokens).withColumns({
        "payload": F.when(known, F.array_join(swapped, "")).otherwise(F.col("content")),
        "tokens_used": F.when(known, F.array_sort(F.array_distinct(met))).otherwise(F.array().cast("array<string>")),
        "n_replaced": F.when(known, F.size(met)).otherwise(0).cast("long"),
    }).drop("_shelves", "_tokens")


def restored(texts: DataFrame, dictionary: DataFrame, spread_by: list[str] = ("path",)) -> DataFrame:
    """Put the words back into ``payload``; adds ``content``. The dictionary is (project_id, token, word)."""
    shelves = frozen(_shelves(dictionary.select("project_id", F.col("token").alias("word"), F.col("word").alias("token"))))
    runs = F.regexp_extract_all("payload", F.lit("§[0-9]+|[^§]+|§"), F.lit(0))
    joined = lookup_join(texts, shelves, ["project_id"], ["project_id", *spread_by])
    whole = F.array_join(F.transform(runs, lambda run: F.coalesce(_token_of(run), run)), "")
    return joined.withColumn("content", F.when(F.col("_shelves").isNotNull(), whole).otherwise(F.col("payload"))).drop("_shelves")
