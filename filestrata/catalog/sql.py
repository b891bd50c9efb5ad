"""Shared SQL fragments of the check queries: the same files tables, written for DuckDB."""

WS = r"\p{Z}\t-\r\x1c-\x1f\x{85}"
EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Characters of str.strip(), for trim(text, chars).
WS_CHARS = "(" + "||".join(f"chr({c})" for c in [
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) + ")"

FILES = rf"""
WITH stored AS (
  SELECT doc_id, source AS project_id,
    lang || '/' || (['src/core', 'tests', '.git/objects', 'config', 'docs/__pycache__'])[(doc_id // 160) % 5 + 1]
      || '/d' || doc_id
      || (['.py', '.md', '.json', '.yml', '.csv', '.js', '.png', '/README'])[(doc_id // 20) % 8 + 1] AS path,
    CASE WHEN (doc_id // 60) % 7 = 4 THEN '# License: MIT' || chr(10) ELSE '' END || text ||
    CASE (doc_id // 60) % 7
      WHEN 0 THEN ''
      WHEN 1 THEN chr(10) || '# TODO: tidy' || chr(10) || '  #fixme later, not TODOS' || chr(10)
      WHEN 2 THEN chr(13) || chr(10) || '# Heading One' || chr(13) || chr(10) || '## Second ##' || chr(13) || chr(10)
        || 'plain' || chr(13) || 'lone'
      WHEN 3 THEN chr(10) || '"key_a": 1' || chr(10) || '''mode'' = 2' || chr(10) || '"key_a": 3' || chr(10)
      WHEN 4 THEN chr(10) || '// copyright notice placed late' || chr(10)
      WHEN 5 THEN chr(10) || ' ' || chr(9) || ' ' || chr(10) || chr(9) || chr(10) || 'word' || chr(160)
        || 'word' || chr(12288) || 'x' || chr(11) || 'vt' || chr(8232) || 'ls' || chr(10)
        || 'plain § mark, §9 and §12345' || chr(10)
      ELSE chr(10) || 'import os' || chr(10) || 'class Model: config argparse tkinter' || chr(10)
    END AS raw_text
  FROM documents
), files AS (
  SELECT project_id, path, CAST(strlen(raw_text) AS BIGINT) AS size_bytes, doc_id % 28 + 1 AS day, raw_text,
    CASE WHEN path NOT LIKE '%.png' THEN
      replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS content,
    CASE WHEN path NOT LIKE '%.png' THEN 'ok' ELSE 'not_text' END AS read_status
  FROM stored
), counted AS (
  SELECT *, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines,
    CAST(len(regexp_extract_all(content, '[^{WS}]+')) AS BIGINT) AS words
  FROM files
)
"""

# Path parts of the document files.
NAME = "regexp_extract(path, '[^/]*$')"
SUFFIX = "lower(regexp_extract(path, '[^/.][^/]*([.][^./]+)$', 1))"
LINES = f"string_split_regex(content, '{EOL}')"


def stripped(expr: str) -> str:
    return f"trim({expr}, {WS_CHARS})"


def nonblank_lines(expr: str = "content") -> str:
    lines = f"string_split_regex({expr}, '{EOL}')"
    return f"list_filter(list_transform({lines}, lambda l: {stripped('l')}), lambda l: l <> '')"
