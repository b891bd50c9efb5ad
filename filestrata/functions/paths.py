"""Expressions over a file's path: its parts, its filters and its classes."""
from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from . import fixed


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _raw_suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)\z", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; '' for none and for dot-files."""
    return F.lower(_raw_suffix(path))


def stem(path: Column) -> Column:
    file_name = name(path)
    return F.substring(file_name, F.lit(1), F.length(file_name) - F.length(_raw_suffix(path)))


def components(path: Column) -> Column:
    """Path components as an array; arrays order component by component."""
    return F.split(path, "/")


def top_component(path: Column) -> Column:
    """First directory, NULL for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """Every directory above the file, the root ('') first."""
    parts = components(path)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
    )


def module_id(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))


def path_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


# --- predicates ------------------------------------------------------------------------

def _alternatives(words: Iterable[str]) -> str:
    return "|".join(re.escape(word) for word in words)


def is_visible(path: Column) -> Column:
    """No component is hidden or on the exclusion lists."""
    hidden = (
        r"(?:^|/)(?:\.|(?:" + _alternatives(fixed.EXCLUDED_NAMES) + r")(?:/|\z)"
        r"|(?iu:" + _alternatives(fixed.EXCLUDED_NAMES_ANY_CASE) + r")(?:/|\z))"
    )
    return ~path.rlike(hidden)


def is_listed(path: Column) -> Column:
    """The looser filter behind the plain file count: file names only need not be dotted."""
    return ~path.rlike(
        r"(?:^|/)(?:\.|(?:" + _alternatives(fixed.EXCLUDED_NAMES) + r")/)"
    )


def _one_of(value: Column, words: list[str]) -> Column:
    """Membership in constants, which the optimizer turns into a hash set."""
    return value.isin(words)


def is_text(path: Column) -> Column:
    ext = suffix(path)
    return _one_of(ext, fixed.TEXT_EXTENSIONS) | (
        (ext == "") & F.lower(name(path)).isin(fixed.TEXT_NAMES)
    )


def is_capsule_text(path: Column) -> Column:
    return _one_of(suffix(path), fixed.CAPSULE_TEXT_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """Anchored Java/RE2 regex of a shell glob whose ``*`` also crosses ``/``."""
    out, rest = "", pattern
    while rest:
        bracket = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if rest[0] == "*":
            rest = rest.lstrip("*")
            out += ".*"
        elif rest[0] == "?":
            rest, out = rest[1:], out + "."
        elif bracket:
            negated, members = bracket.groups()
            members = re.sub(r"([\\\[\]&^~])", r"\\\1", members)
            out += "[" + ("^" if negated else "") + members + "]"
            rest = rest[bracket.end():]
        else:
            rest, out = rest[1:], out + re.escape(rest[0])
    return r"(?s)^(?:" + out + r")\z"


def glob_selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; with no includes everything that is not excluded is kept."""
    def any_of(patterns: list[str]) -> Column:
        return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))

    kept = any_of(include) if include else F.lit(True)
    return kept & ~any_of(exclude) if exclude else kept


# --- classes ---------------------------------------------------------------------------

def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a constant map, which the optimizer folds from one literal."""
    entries = ";".join(f"{k}:{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(entries), F.lit(";"), F.lit(":")), key)


def language(path: Column, dialect: str) -> Column:
    ext = suffix(path)
    known = _lookup(fixed.LANGUAGES[dialect], ext)
    if dialect == "engine":
        default = F.lit("unknown")
    elif dialect == "content":
        default = F.lit("text")
    elif dialect == "capsule":
        default = F.when(_one_of(ext, fixed.CAPSULE_TEXT_EXTENSIONS), "text").otherwise("binary")
    else:
        bare = F.ltrim(ext, F.lit("."))
        default = F.when(bare == "", "file").otherwise(bare)
    return F.coalesce(known, default)


def has_deep_text(path: Column) -> Column:
    return ~_one_of(language(path, "deep"), fixed.MEDIA_LANGUAGES)


def section_kind(path: Column) -> Column:
    ext, file_name = suffix(path), F.lower(name(path))
    return (
        F.when(_one_of(ext, fixed.CONFIG_EXTENSIONS) | file_name.isin(fixed.CONFIG_NAMES), "config")
        .when(_one_of(ext, fixed.DOC_EXTENSIONS) | file_name.startswith("readme"), "docs")
        .when(_one_of(ext, fixed.CODE_EXTENSIONS), "code")
        .when(_one_of(ext, fixed.DATA_EXTENSIONS), "data")
        .when(~is_capsule_text(path), "binary")
        .otherwise("text")
    )


def mime_type(path: Column) -> Column:
    """MIME type of the file name, NULL when unknown; a compression suffix is looked through."""
    file_name = name(path)
    for alias, full in fixed.MIME_ALIASES.items():
        file_name = F.regexp_replace(file_name, r"(?i)(?<=.)" + re.escape(alias) + r"\z", full)
    packed = _alternatives(fixed.MIME_ENCODINGS)
    inner = F.regexp_replace(file_name, r"(?s)(?<=.)(?:" + packed + r")\z", "")
    return _lookup(fixed.MIME_TYPES, suffix(inner))


def mime_or_default(path: Column) -> Column:
    return F.coalesce(mime_type(path), F.lit("application/octet-stream"))


def role_from_symbols(path: Column, n_windows: Column, n_classes: Column, n_functions: Column,
                      n_imports: Column) -> Column:
    """Purpose of a file from its path, then from what it defines; the first match wins."""
    base = F.lower(stem(path))
    return (
        F.when(F.contains(F.lower(path), F.lit("test")), "Testing")
        .when(base.isin("main", "__main__", "app", "run"), "Entry point")
        .when(base.isin("config", "settings", "constants"), "Configuration")
        .when(base.startswith("gui") | base.endswith("_gui") | (n_windows > 0), "User interface")
        .when(base.rlike("util|helper|tool"), "Utilities")
        .when(base.isin("models", "schema", "data"), "Data models")
        .when(base.rlike(r"_(?:client|api)\z"), "API client")
        .when((n_classes > 0) & (n_functions == 0), "Class definitions")
        .when((n_functions > 0) & (n_classes == 0), "Functions/utilities")
        .when(n_imports > 0, "Module integration")
        .otherwise("Core logic")
    )


def role_from_content(path: Column, content: Column) -> Column:
    """Purpose of a file from words in its text; NULL when nothing matches."""
    text = F.coalesce(content, F.lit(""))
    lowered = F.lower(text)
    return (
        F.when(F.contains(lowered, F.lit("tkinter")), "GUI layer")
        .when(lowered.rlike("argparse|click"), "CLI or entrypoint")
        .when(F.contains(text, F.lit("class ")) & F.contains(F.lower(name(path)), F.lit("test")), "Tests")
        .when(F.array_contains(components(path), "config"), "Configuration")
        .when(F.contains(lowered, F.lit("model")) & F.contains(text, F.lit("class")), "Domain model")
    )
