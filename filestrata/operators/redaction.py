"""Redaction of files by a table of rules.

A rule is a row (`rule, kind, value`): a `literal` to be found as it stands, or a `pattern`, a regular expression. All literals of all
rules make one automaton, which reads a text once whatever their number; patterns are tried one by one. Where matches overlap, the one
that begins first wins, of those the longest, and of those the first rule by name; the others are dropped, so spans
never overlap and every character is replaced once at most. Matches of one rule may be longer than their literal only for patterns.
Empty literals, empty matches, and rows with a null match nothing.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters of all rules together; they reach every task.
RULE_CHARS = 64 << 20

# Rules for secrets and addresses.
DEFAULT_RULES = [
    ("email", "pattern", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("private_key", "pattern", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("token", "pattern", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}\b|\bxox[abprs]-[0-9A-Za-z-]{10,}|\bsk-[0-9A-Za-z_-]{20,}"),
    ("password", "pattern", r"(?i)(?<=password=)[^\s&'\"]+|(?<=passwd=)[^\s&'\"]+"),
]


class Matcher:
    """Finds the spans of all rules in a text."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_literal: dict[str, str] = {}
        for rule, kind, value in rules:
            if kind == "literal" and value:
                by_literal[value] = min(rule, by_literal.get(value, rule))
        self.literals = ahocorasick.Automaton()
        for value, rule in by_literal.items():
            self.literals.add_word(value, (len(value), rule))
        if by_literal:
            self.literals.make_automaton()
        self.any = bool(by_literal)
        self.patterns = [(rule, re.compile(value)) for rule, kind, value in sorted(rules) if kind == "pattern"]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, stop, rule) in order."""
        met = [(stop - size + 1, -size, rule) for stop, (size, rule) in (self.literals.iter(text) if self.any else ())]
        for rule, pattern in self.patterns:
            met += [(m.start(), m.start() - m.end(), rule) for m in pattern.finditer(text) if m.end() > m.start()]
        out, free = [], 0
        for start, less, rule in sorted(met):
            if start >= free:
                free = start - less
                out.append((start, free, rule))
        return out


def rule_rows(rules: DataFrame) -> list[tuple[str, str, str]]:
    """The usable rules, after a check that they are small enough to reach every task."""
    rules = rules.select("rule", "kind", "value").na.drop().distinct()
    other = rules.filter(~F.col("kind").isin("literal", "pattern")).take(1)
    if other:
        raise ValueError(f"a rule is a literal or a pattern, not {other[0]['kind']!r}")
    size = rules.agg(F.sum(F.length("rule") + F.length("value"))).first()[0] or 0
    if size > RULE_CHARS:
        raise ValueError(f"the rules have {size} characters; {RULE_CHARS} can be taken to every task")
    return sorted(tuple(r) for r in rules.collect())


def _mapped(files: DataFrame, rules: DataFrame, schema: str, make) -> DataFrame:
    held = files.sparkSession.sparkContext.broadcast(rule_rows(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value)
        for batch in batches:
            for part in make(batch, matcher):
                yield part

    return files.select("project_id", "path", "content").mapInArrow(run, schema)


def redactions(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``project_id, path, start, stop, rule`` of every span that a rule hides; offsets count characters."""

    def make(batch, matcher):
        for i, text in enumerate(batch.column("content")):
            spans = matcher.spans(text.as_py() or "")
            if spans:
                starts, stops, names = map(list, zip(*spans))
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([batch.column(c)[i].as_py()] * len(spans), pa.string()) for c in ("project_id", "path")),
                    pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(names, pa.string()),
                ], ["project_id", "path", "start", "stop", "rule"])

    return _mapped(files, rules, "project_id string, path string, start long, stop long, rule string", make)


def redacted(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``project_id, path, content, n_redactions``: each hidden span is the rule's name in brackets. A null content stays null."""

    def make(batch, matcher):
        texts, counts = [], []
        for text in batch.column("content").to_pylist():
            out, at, spans = [], 0, matcher.spans(text or "")
            for start, stop, rule in spans:
                out += [text[at:start], f"[{rule}]"]
                at = stop
            texts.append(None if text is None else "".join(out) + text[at:])
            counts.append(len(spans))
        yield pa.RecordBatch.from_arrays([batch.column("project_id"), batch.column("path"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                         ["project_id", "path", "content", "n_redactions"])

    return _mapped(files, rules, "project_id string, path string, content string, n_redactions long", make)


def redaction_report(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Per project and rule the spans, files and characters that it hides."""
    return redactions(files, rules).groupBy("project_id", "rule").agg(
        F.count("*").alias("n_spans"), F.count_distinct("path").alias("n_files"), F.sum(F.col("stop") - F.col("start")).alias("n_chars"))
