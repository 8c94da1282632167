"""Tolerant text-protobuf reading into typed family rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMENT = re.compile(r"^\s*#.*$", re.MULTILINE)
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([{}:])|([^\s{}:"]+)')
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "'": "'", "\\": "\\"}

FAMILY = "name string, category string, subsets array<string>, axes array<struct<tag:string,min_value:double,max_value:double>>, fonts array<struct<filename:string,style:string,weight:int,post_script_name:string,full_name:string>>"


def _scalar(word: str):
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def parse(text: str) -> dict:
    """A message as a dict; a field that repeats becomes a list; stray tokens are skipped."""
    root: dict = {}
    stack = [root]
    field: str | None = None
    for quoted, mark, word in ((m[1], m[2], m[3]) for m in _TOKEN.finditer(_COMMENT.sub("", text))):
        if mark == "}":
            if len(stack) > 1:
                stack.pop()
            field = None
        elif mark == "{":
            child: dict = {}
            if field is not None:
                _put(stack[-1], field, child)
                stack.append(child)
            else:
                stack.append({})
            field = None
        elif mark == ":":
            continue
        elif field is None:
            field = word or None
        else:
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), quoted) if quoted is not None else _scalar(word)
            _put(stack[-1], field, value)
            field = None
    return root


def _put(message: dict, field: str, value) -> None:
    if field not in message:
        message[field] = value
    elif isinstance(message[field], list):
        message[field].append(value)
    else:
        message[field] = [message[field], value]


def _listed(message: dict, *fields: str) -> dict:
    return message | {f: message[f] if isinstance(message.get(f), list) else [message[f]] if f in message else [] for f in fields}


def parse_families(texts: DataFrame, text: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw texts to typed rows of ``FAMILY``; repeatable fields are always arrays."""

    @F.pandas_udf("string")
    def to_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else json.dumps(_listed(parse(t), "subsets", "axes", "fonts"), ensure_ascii=False))

    return texts.select(*carry, F.from_json(to_json(F.col(text)), FAMILY).alias("_f")).select(*carry, "_f.*")


def load_catalog(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a glob, with their folder, in the order of their paths."""
    raw = spark.read.text(pattern, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "").alias("dir"), F.col("_metadata.file_path").alias("_path"))
    return parse_families(raw, carry=("dir", "_path")).orderBy("_path").drop("_path")


def first(values, default):
    """The first of a list column, the default where there is none."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(default))


def normalize_family(df: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Family rows: mapped or lower-cased category, variable if a file name has a bracket, weight 400 and style normal by default."""
    known = {"SANS_SERIF": "sans-serif", "SERIF": "serif", "DISPLAY": "display", "HANDWRITING": "handwriting", "MONOSPACE": "monospace"} | (categories or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    fonts = F.transform("fonts", lambda f: F.struct(f["filename"].alias("filename"), F.coalesce(f["style"], F.lit("normal")).alias("style"), F.coalesce(f["weight"], F.lit(400)).alias("weight"), f["post_script_name"].alias("post_script_name"), f["full_name"].alias("full_name")))
    return df.withColumns({"family": F.col("name"), "category": F.coalesce(table[F.col("category")], F.lower("category")), "fonts": fonts}).withColumn("variable", F.exists("fonts", lambda f: f["filename"].contains("["))).drop("name")
