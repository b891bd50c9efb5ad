"""Compressed exports as whole JSON documents with all that is needed to decode them, and their readers.

Every array of a document has one line per entry, so a document is an ordered table of parts like any other dump, and a reader tells from
the shape of a line what it holds.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import dictionary as words
from ..operators import packing
from ..operators.joins import lookup_join
from ..session import frozen
from . import corpus
from .capsule import Capsule, section_documents

PART = ["project_id", "section", "place", "path", "block"]


def _fixed_part(projects: DataFrame, section: int, block: Column | str) -> DataFrame:
    return projects.select(
        "project_id", F.lit(section).alias("section"), F.lit("").alias("place"), F.lit("").alias("path"),
        (F.lit(block) if isinstance(block, str) else block).alias("block"))


def _listed(entries: DataFrame, section: int) -> DataFrame:
    """Entries (project_id, place, path, block) as lines of an array or object: all but a project's last end in a comma."""
    last = entries.groupBy("project_id").agg(F.max(F.struct("place", "path")).alias("last"))
    joined = lookup_join(entries, last, ["project_id"], ["place", "path"])
    comma = F.when(F.struct("place", "path") == F.col("last"), "").otherwise(",")
    return joined.select("project_id", F.lit(section).alias("section"), "place", "path", F.concat("block", comma).alias("block"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _dictionary_lines(dictionary: DataFrame, section: int) -> DataFrame:
    """`"§1": "word"` lines, in order of rank."""
    entry = F.concat(F.lit('"'), "token", F.lit('": "'), "word", F.lit('"'))  # words are letters, digits and underscores
    return _listed(dictionary.select("project_id", F.lpad(F.col("rank").cast("string"), 8, "0").alias("place"), F.lit("").alias("path"), entry.alias("block")), section)


def tds_document(analysis: DataFrame, size: int = 256) -> DataFrame:
    """The dictionary-compressed description of each project: head, dictionary, then the payload, a line each file."""
    dictionary, segments = corpus.corpus_document(analysis, size)
    projects = segments.filter("section = 0").select("project_id")
    head = F.concat(
        F.lit('{"format": "llm-tds", "version": "1.0", "project": '), _json(name=F.col("project_id")), F.lit(',\n"dictionary": {'))
    place = F.concat(F.col("section").cast("string"), F.lit(" "), F.col("place"))
    payload = segments.select("project_id", place.alias("place"), "path", _json(path=F.col("path"), payload=F.col("payload")).alias("block"))
    return reduce(DataFrame.unionByName, [
        _fixed_part(projects, 0, head), _dictionary_lines(dictionary, 1),
        _fixed_part(projects, 2, '},\n"content": {"codec": "tds_v1", "payload": ['), _listed(payload, 3), _fixed_part(projects, 4, "]}}")])


def capsule_document(capsule: Capsule) -> DataFrame:
    """Each project's capsule: head with its summary, root and fingerprint, then dictionary, hash tree and sections."""
    heads = frozen(capsule.summary.join(capsule.roots, "project_id").join(capsule.fingerprints, "project_id"))
    head = F.concat(
        F.lit('{"format": "lrc-capsule", "project": '), _json(name=F.col("project_id")), F.lit(', "summary": '),
        _json(files=F.col("files"), bytes=F.col("bytes"), highlights=F.col("highlights")), F.lit(', "fingerprint": "'), "fingerprint",
        F.lit('",\n"dictionary": {'))
    root = F.concat(F.lit('},\n"merkle": {"algo": "sha256", "root": "'), "root", F.lit('", "nodes": ['))
    order = F.concat(F.lpad(F.col("level").cast("string"), 4, "0"), F.lit(" "), F.lpad(F.col("idx").cast("string"), 20, "0"))
    nodes = capsule.tree.select("project_id", order.alias("place"), F.lit("").alias("path"), _json(
        node=F.col("node_id"), level=F.col("level"), index=F.col("idx"), hash=F.col("hash")).alias("block"))
    sections = section_documents(capsule).select("project_id", "place", "path", "block")
    return reduce(DataFrame.unionByName, [
        _fixed_part(heads, 0, head), _dictionary_lines(capsule.dictionary, 1), _fixed_part(heads, 2, root),
        _listed(nodes, 3), _fixed_part(heads, 4, ']},\n"sections": ['), _listed(sections, 5), _fixed_part(heads, 6, "]}")])


# --- readers, over `project_id, line` ---------------------------------------------------


def dictionary_of(lines: DataFrame) -> DataFrame:
    """``project_id, token, word`` of the dictionary lines of documents."""
    pattern = r'\A"(§\d+)": "([\p{L}\p{N}_]+)",?\z'
    found = lines.filter(F.col("line").rlike(pattern))
    return found.select("project_id", F.regexp_extract("line", pattern, 1).alias("token"), F.regexp_extract("line", pattern, 2).alias("word"))


def _entries(lines: DataFrame, start: str, schema: str) -> DataFrame:
    found = lines.filter(F.startswith("line", F.lit(start)))
    return found.select("project_id", F.from_json(F.regexp_replace("line", r",\z", ""), schema).alias("e")).select("project_id", "e.*")


def tds_texts(lines: DataFrame) -> DataFrame:
    """``project_id, path, content``: the payload of llm-tds documents with its words put back."""
    payload = _entries(lines, '{"path":', "path string, payload string")
    return words.restored(payload, dictionary_of(lines)).select("project_id", "path", "content")


def capsule_sections(lines: DataFrame) -> DataFrame:
    """``project_id, path, section_id, sha256, data, intact, content`` of capsule documents.

    ``data`` are the file's bytes from the lossless payload; ``content`` is the text of the substituted payload with its words put
    back, and ``intact`` tells whether it has the section's hash. A text that holds a token's spelling itself cannot come back from
    its substituted payload.
    """
    schema = ("id string, path string, hash string, tool struct<codec:string,payload:string>, "
              "llm struct<content:struct<payload:string>>")
    sections = _entries(lines, '{"id":"sec-', schema).select(
        "project_id", "path", F.col("id").alias("section_id"), F.regexp_replace("hash", "^sha256:", "").alias("sha256"),
        F.col("tool.payload").alias("packed"), F.col("tool.codec").alias("codec"), F.col("llm.content.payload").alias("payload"))
    back = words.restored(sections, dictionary_of(lines))
    data = F.when(F.col("codec") == "none", packing.unpack(F.col("packed"), "none")).otherwise(
        packing.unpack(F.when(F.col("codec") != "none", F.col("packed"))))
    return back.select("project_id", "path", "section_id", "sha256", data.alias("data"),
                       (F.sha2("content", 256) == F.col("sha256")).alias("intact"), "content")


def capsule_tree(lines: DataFrame) -> DataFrame:
    """``project_id, node, level, index, hash`` of the hash trees of capsule documents."""
    return _entries(lines, '{"node":', "node string, level int, index long, hash string")
