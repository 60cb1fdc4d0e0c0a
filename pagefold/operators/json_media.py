"""Media references inside LLM JSON results (M13, M14, M15, M16 apply).

A result's references are wanted in document order (a url is later
deduplicated "first seen"), and JSON object key order is not kept by
VARIANT, so one small helper flattens each document into its string leaves
in an Arrow-batched pandas UDF, with a stack instead of recursion, so any
depth that the JSON parser reads is safe. Which leaves are media, dedupe and
scoring are DataFrame expressions. It runs only on the (gated, few) LLM
result rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import IMAGE_EXTENSIONS, MEDIA_JSON_KEYS, VIDEO_EXTENSIONS, alternation

_LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
                      T.StructField("value", T.StringType())])


def string_leaves(doc) -> list[tuple[str, str | None, str]]:
    """(path, own key, value) of every string in a JSON document, in order.

    An object's member has its key as ``name``; an array's item has none.
    """
    leaves = []
    todo = [("", None, doc)]
    while todo:
        path, name, node = todo.pop()
        if isinstance(node, str):
            leaves.append((path, name, node))
        elif isinstance(node, list):
            todo += [(f"{path}[{i}]", None, node[i]) for i in reversed(range(len(node)))]
        elif isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else k, k, node[k]) for k in reversed(list(node))]
    return leaves


@F.pandas_udf(T.ArrayType(_LEAF))
def _leaves(js: pd.Series) -> pd.Series:
    def of(text):
        try:
            doc = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return []
        if isinstance(doc, dict) and "content" in doc:
            doc = doc["content"]
        return [dict(zip(("path", "name", "value"), leaf)) for leaf in string_leaves(doc)]
    return js.map(of)


def _any_in(value: Column, extensions) -> Column:
    return F.lower(value).rlike(alternation(extensions))


def ai_media(results: DataFrame, json_col: str, keys: list[str], mode: str = "api") -> DataFrame:
    """One row per media reference found in each JSON result, with
    ``ord`` (document order) and context "AI found: <path>". ``api`` (M13): a
    string under a media key that has a media extension; ``app`` (M14): any
    string under a media key, and any array item or bare string that has a
    media extension."""
    def refers(leaf: Column) -> Column:
        under = F.coalesce(F.lower(leaf["name"]).isin(*MEDIA_JSON_KEYS), F.lit(False))
        looks = _any_in(leaf["value"], IMAGE_EXTENSIONS + VIDEO_EXTENSIONS)
        return under & looks if mode == "api" else under | (leaf["name"].isNull() & looks)

    leaves = results.select(*keys, _leaves(F.col(json_col)).alias("leaves"))
    return leaves.select(*keys, F.posexplode(F.filter("leaves", refers)).alias("ord", "m")).select(*keys, "ord", "m.*").select(
        *keys, "ord", F.col("value").alias("media_url"),
        F.when(_any_in(F.col("value"), VIDEO_EXTENSIONS), "video").otherwise("image").alias("type"),
        F.concat(F.lit("AI found: "), "path").alias("context"))


def first_seen(html_media: DataFrame, llm_media: DataFrame, key: str = "page_id") -> DataFrame:
    """HTML media then LLM media, deduplicated by raw url keeping the
    first seen (a partial ``min_by`` aggregate per (page, url))."""
    h = html_media.select(key, "media_url", "type", "context",
                          F.struct(F.lit(0).alias("src"), "pass_no", "node_id", "sub").alias("o"))
    a = llm_media.select(key, "media_url", "type", "context",
                         F.struct(F.lit(1).alias("src"), F.lit(0).alias("pass_no"), F.col("ord").alias("node_id"),
                                  F.lit(0).alias("sub")).alias("o"))
    u = h.unionByName(a)
    g = u.groupBy(key, "media_url").agg(F.min_by(F.struct("type", "context"), "o").alias("v"),
                                        F.min("o").alias("o"))
    return g.select(key, "media_url", F.col("v.type").alias("type"), F.col("v.context").alias("context"), "o")
