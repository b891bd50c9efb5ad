"""Explicit schemas of the tables the jobs exchange; nothing is inferred."""
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("project_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("size_bytes", T.LongType(), False),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_bytes", T.BinaryType()),
    T.StructField("lines", T.LongType()),
    T.StructField("words", T.LongType()),
    T.StructField("read_status", T.StringType()),
])

_ARG = T.StructType([
    T.StructField("slot", T.StringType()),       # posonly, plain, vararg, kwonly, kwarg
    T.StructField("name", T.StringType()),
    T.StructField("note", T.StringType()),       # annotation as written
    T.StructField("note_name", T.StringType()),  # annotation as a dotted name
])

# One row per parsed Python file: what the syntax tree says, before any dialect's rules.
FACTS = T.StructType([
    T.StructField("parse_ok", T.BooleanType()),
    T.StructField("doc", T.StringType()),
    T.StructField("decisions", T.IntegerType()),
    T.StructField("main_guard", T.BooleanType()),
    T.StructField("imports", T.ArrayType(T.StructType([
        T.StructField("depth", T.IntegerType()),
        T.StructField("seen", T.IntegerType()),    # place in source order
        T.StructField("top", T.BooleanType()),
        T.StructField("module", T.StringType()),   # NULL for a plain import
        T.StructField("names", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("classes", T.ArrayType(T.StructType([
        T.StructField("depth", T.IntegerType()),
        T.StructField("seen", T.IntegerType()),    # place in source order
        T.StructField("top", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualname", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("doc", T.StringType()),
        T.StructField("bases", T.ArrayType(T.StringType())),
        T.StructField("base_names", T.ArrayType(T.StringType())),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("methods", T.ArrayType(T.StringType())),
        T.StructField("sync_methods", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("functions", T.ArrayType(T.StructType([
        T.StructField("depth", T.IntegerType()),
        T.StructField("seen", T.IntegerType()),    # place in source order
        T.StructField("top", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualname", T.StringType()),
        T.StructField("is_async", T.BooleanType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("doc", T.StringType()),
        T.StructField("args", T.ArrayType(_ARG)),
        T.StructField("returns", T.StringType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("branches", T.IntegerType()),
        T.StructField("main_guard", T.BooleanType()),
    ]))),
    T.StructField("calls", T.ArrayType(T.StructType([
        T.StructField("target", T.StringType()),   # any callee, as text
        T.StructField("dotted", T.StringType()),   # trailing name chain only
        T.StructField("first_arg", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("value", T.StringType()),
        ]))),
    ]))),
    T.StructField("subscripts", T.ArrayType(T.StructType([
        T.StructField("target", T.StringType()),
        T.StructField("key", T.StringType()),
    ]))),
    T.StructField("strings", T.ArrayType(T.StringType())),
])
