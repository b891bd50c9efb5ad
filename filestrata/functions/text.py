"""Expressions over a file's text: counters, markers, excerpts and normal forms."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters counted as white space, and those that end a line.
SPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
OTHER_BREAKS = "".join(map(chr, [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))
LINE_END = rf"\r\n|[{BREAKS}]"
WORD_CHAR = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    """From the first visible character to the last; '' when there is none."""
    return F.regexp_extract(text, rf"(?s)[^{SPACE}](?:.*[^{SPACE}])?", 0)


def rstrip(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?s)^.*[^{SPACE}]", 0)


def is_blank(text: Column) -> Column:
    """No visible character; the search stops at the first one."""
    return ~text.rlike(rf"[^{SPACE}]")


def unify_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalise_eol(text: Column, eol: str = "LF") -> Column:
    """LF line ends; under ``LF`` non-empty text also ends in exactly one."""
    unified = unify_newlines(text)
    if eol.upper() != "LF":
        return unified
    closed = F.concat(rstrip(unified), F.lit("\n"))
    return F.when(unified == "", unified).otherwise(closed)


def unify_breaks(text: Column) -> Column:
    """Every line end as one LF. Plain replacements cost far less than a pattern per character."""
    unified = unify_newlines(text)
    for mark in OTHER_BREAKS:
        unified = F.replace(unified, F.lit(mark), F.lit("\n"))
    return unified


def split_lines(text: Column, limit: int = -1) -> Column:
    return F.split(unify_breaks(text), "\n", limit)


def _feeds(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    return F.when(is_blank(text), 0).otherwise(_feeds(text) + 1).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("long")


def sloc(text: Column) -> Column:
    """Non-blank lines: one match runs from a line's first visible character to its end."""
    found = F.regexp_count(unify_breaks(text), F.lit(rf"(?d)[^{SPACE}].*"))
    return F.coalesce(found, F.lit(0)).cast("long")


def comment_markers(text: Column) -> Column:
    found = F.regexp_count(text, F.lit(rf"(?iu)#[{SPACE}]*(?:TODO|FIXME|XXX)"))
    return F.coalesce(found, F.lit(0)).cast("long")


def word_markers(text: Column) -> Column:
    found = F.regexp_count(
        text, F.lit(rf"(?iu)(?=[tfx])(?<![{WORD_CHAR}])(?:TODO|FIXME|XXX)(?![{WORD_CHAR}])"))
    return F.coalesce(found, F.lit(0)).cast("long")


def has_licence_header(text: Column) -> Column:
    """The first 20 lines mention a licence; the rest of the text is not split."""
    head = F.array_join(F.slice(F.split(text, LINE_END, 21), 1, 20), "\n")
    return F.coalesce(F.lower(head).rlike("license|copyright"), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def preview(text: Column, limit: int = 10) -> Column:
    """The first lines, then how many more there are; short texts come back unchanged."""
    unified = unify_breaks(text)
    total = _feeds(unified) + F.when(unified.endswith("\n"), 0).otherwise(1)
    head = F.array_join(F.slice(F.split(unified, "\n", limit + 1), 1, limit), "\n")
    more = F.concat(F.lit("\n... ("), (total - limit).cast("string"), F.lit(" more lines)"))
    return (
        F.when(text.isNull() | (text == ""), "")
        .when(total <= limit, text)
        .otherwise(F.concat(head, more))
    )


def stripped_lines(text: Column) -> Column:
    """Non-blank lines, stripped: from a line's first visible character to its last."""
    return F.regexp_extract_all(
        unify_breaks(text), F.lit(rf"(?d)[^{SPACE}](?:.*[^{SPACE}])?"), F.lit(0))


def summary(text: Column, file_name: Column, limit: int = 3) -> Column:
    lines = F.slice(stripped_lines(text), 1, limit)
    return F.when(F.size(lines) > 0, lines).otherwise(
        F.array(F.concat(file_name, F.lit(" (empty)"))))


def headings(text: Column, limit: int, indented: bool = False) -> Column:
    """Lines marked with ``#``, marker removed; ``indented`` also takes marks after white space."""
    def marked(line: Column) -> Column:
        return (strip(line) if indented else line).startswith("#")

    found = F.filter(split_lines(text), marked)
    return F.slice(F.transform(found, lambda line: F.btrim(line, F.lit("# "))), 1, limit)


def config_keys(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"[\"']([A-Za-z0-9_.-]+)[\"'][{SPACE}]*[:=]"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def short_lines(text: Column, below: int = 120) -> Column:
    return F.array_distinct(F.filter(stripped_lines(text), lambda line: F.length(line) < below))


def first_line(text: Column) -> Column:
    """First non-blank line, stripped; NULL when there is none."""
    return F.get(stripped_lines(text), F.lit(0))


def tokens(text: Column) -> Column:
    """The text cut into word and non-word runs; joined again they give it back."""
    return F.regexp_extract_all(text, F.lit(rf"[{WORD_CHAR}]+|[^{WORD_CHAR}]+"), F.lit(0))


def file_size(size: Column) -> Column:
    """Size with one decimal, halves to even, as 'B', 'KB', 'MB', 'GB' or 'TB'."""
    def shown(power: int, unit: str) -> Column:
        scaled = F.bround(size / F.lit(float(1024 ** power)), 1)
        return F.format_string(f"%.1f {unit}", scaled)

    out = F.when(size < 1024, shown(0, "B"))
    for power, unit in enumerate(["KB", "MB", "GB"], start=1):
        out = out.when(size < 1024 ** (power + 1), shown(power, unit))
    return out.otherwise(shown(4, "TB"))


def kilobytes(size: Column) -> Column:
    return F.concat(F.floor(F.greatest(size, F.lit(0)) / 1024).cast("string"), F.lit(" KB"))
