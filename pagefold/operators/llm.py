"""LLM enrichment as a batch inference job.

The model itself is a user function (the reference calls a hosted model;
no provider is bundled). It runs in ``mapInPandas`` over Arrow batches of
ONLY the rows that pass the AI gate, with per-row error isolation, so one
bad response never fails the job. Everything around the call — prompt
layout, token and cost estimates, JSON parsing, profile mapping,
completeness checks — is built-in expressions.
"""

from __future__ import annotations

import json
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    NO_LOCATION, NOT_AVAILABLE, PROFILE_SECTIONS, PROMPT_TEMPLATE, REQUIRED_PROFILE_FIELDS, sql_array,
)
from ..session import materialize
from .facts import classic_location

ModelFn = Callable[[str], dict]


def build_prompt(system, user) -> Column:
    """L1: the Human/Assistant prompt layout."""
    a, rest = PROMPT_TEMPLATE.split("{system}")
    b, c = rest.split("{user}")
    s = F.col(system) if isinstance(system, str) else system
    u = F.col(user) if isinstance(user, str) else user
    return F.concat(F.lit(a), s, F.lit(b), u, F.lit(c))


def estimate_tokens(text) -> Column:
    """L4 (service): ``len(text) // 4``."""
    return F.floor(F.length(F.col(text) if isinstance(text, str) else text) / 4).cast("long")


def word_tokens(text) -> Column:
    """L4 (root log path): whitespace word count."""
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("long")


def parse_completion(completion, has_completion) -> Column:
    """L3: struct(result VARIANT, error). No completion field -> "Invalid
    response format"; text that is not JSON -> "Invalid JSON response"."""
    c = F.col(completion) if isinstance(completion, str) else completion
    h = F.col(has_completion) if isinstance(has_completion, str) else has_completion
    parsed = F.try_parse_json(c)
    err = (F.when(~h, "Invalid response format").when(parsed.isNull(), "Invalid JSON response"))
    return F.struct(F.when(err.isNull(), parsed).alias("result"), err.alias("error"))


def call_model(df: DataFrame, model_fn: ModelFn, prompt_col: str = "prompt",
               model: str = "default") -> DataFrame:
    """L2+L6: apply ``model_fn(prompt) -> response dict`` to every row, in
    Arrow batches. Adds ``completion`` (string), ``has_completion``,
    ``call_error`` (exception text) and ``model``. Exceptions are caught
    per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            comps, has, errs = [], [], []
            for p in pdf[prompt_col]:
                try:
                    resp = model_fn(p)
                    if isinstance(resp, dict) and "completion" in resp:
                        comps.append(resp["completion"])
                        has.append(True)
                    else:
                        comps.append(None)
                        has.append(False)
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - isolate per row
                    comps.append(None)
                    has.append(False)
                    errs.append(str(e) or type(e).__name__)
            yield pdf.assign(completion=comps, has_completion=has, call_error=errs, model=model)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ddl += ", completion string, has_completion boolean, call_error string, model string"
    return df.mapInPandas(run, ddl)


def enrich(df: DataFrame, model_fn: ModelFn, fallback_fn: ModelFn | None = None,
           prompt_col: str = "prompt", model: str = "default", fallback_model: str = "fallback") -> DataFrame:
    """L2+L3+L6+L8: call the model, parse, and re-run failed rows once on a
    fallback model. Adds ``result`` (VARIANT) and ``error``."""
    first = call_model(df, model_fn, prompt_col, model)
    first = first.withColumn("p", parse_completion("completion", "has_completion")).select(
        *df.columns, "model", F.col("p.result").alias("result"),
        F.coalesce("call_error", F.col("p.error")).alias("error"))
    if fallback_fn is None:
        return first
    # the first pass feeds both the kept rows and the retry: persist it so
    # each row's model call happens once (and is not repeated on retry)
    first = materialize(first, "llm-first-pass")
    ok = first.filter(F.col("error").isNull())
    retry = call_model(first.filter(F.col("error").isNotNull()).select(*df.columns), fallback_fn,
                       prompt_col, fallback_model)
    retry = retry.withColumn("p", parse_completion("completion", "has_completion")).select(
        *df.columns, "model", F.col("p.result").alias("result"),
        F.coalesce("call_error", F.col("p.error")).alias("error"))
    return ok.unionByName(retry)


def _vs(result: Column, path: str) -> Column:
    return F.try_variant_get(result, path, "string")


def classic_profile(result) -> Column:
    """X7+X6: map the LLM profile object ``content.profile`` to the five
    profile sections with "Not available" defaults; locations from the
    About text by the classic location ladder, "No location found"."""
    r = F.col(result) if isinstance(result, str) else result
    fields = []
    for key, col in PROFILE_SECTIONS:
        path = "$.content.profile['" + key.replace("'", "\\'") + "']"
        fields.append(F.coalesce(_vs(r, path), F.lit(NOT_AVAILABLE)).alias(col))
    about = _vs(r, "$.content.profile['About Us (including locations)']")
    fields.append(classic_location(F.coalesce(about, F.lit(""))).alias("locations"))
    return F.struct(*fields)


def meaningful_profile(result) -> Column:
    """the ``content.profile`` object exists and has a truthy value."""
    r = F.col(result) if isinstance(result, str) else result
    prof = F.try_variant_get(r, "$.content.profile", "map<string,string>")
    return F.coalesce(F.exists(F.map_values(prof), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(False))


def failure_profile(error: Column) -> Column:
    """The default row when no URL produced a profile."""
    return F.struct(
        *[F.lit(NOT_AVAILABLE).alias(c) for _, c in PROFILE_SECTIONS],
        F.lit(NO_LOCATION).alias("locations"), F.lit(False).alias("success"), error.alias("error"))


def completeness_error(result) -> Column:
    """X8: "Incomplete profile" unless the 4 profile keys are present;
    " Invalid media format" appended when some media item lacks url/type."""
    r = F.col(result) if isinstance(result, str) else result
    keys = F.try_variant_get(r, "$.profile", "map<string,string>")
    has_profile = F.coalesce(F.forall(F.array(*[F.lit(k) for k, _ in PROFILE_SECTIONS]),
                                      lambda k: F.map_contains_key(keys, k)), F.lit(False))
    media = F.try_variant_get(r, "$.media", "array<map<string,string>>")
    media_ok = F.coalesce(F.forall(media, lambda m: F.map_contains_key(m, "url") & F.map_contains_key(m, "type")),
                          F.lit(True))
    e1 = F.when(~has_profile, "Incomplete profile")
    return F.when(~media_ok, F.concat_ws(" ", e1, F.lit("Invalid media format"))).otherwise(e1)


def missing_required(result) -> Column:
    """Required profile fields absent from the LLM JSON object."""
    r = F.col(result) if isinstance(result, str) else result
    obj_keys = F.map_keys(F.try_variant_get(r, "$", "map<string,variant>"))
    return F.array_except(F.expr(sql_array(REQUIRED_PROFILE_FIELDS)), F.coalesce(obj_keys, F.array().cast("array<string>")))


def stub_profile_model(prompt: str) -> dict:
    """A deterministic stand-in model (the reference's own AI path is a
    stub): answers with a JSON profile built from the analysed content.
    Content under 40 characters gets a non-JSON answer, so parse errors and
    the fallback path are exercised."""
    marker = "Here is the content to analyze:\n"
    start = prompt.find(marker)
    content = prompt[start + len(marker):] if start >= 0 else prompt
    end = content.find("\n\nAssistant:")
    content = content[:end] if end >= 0 else content
    if len(content) < 40:
        return {"completion": "I could not find enough content."}
    sentences = [s.strip() for s in content.replace("!", ".").split(".") if s.strip()]
    about = next((s for s in sentences if "based in" in s.lower() or "founded" in s.lower()), sentences[0])
    team = next((s for s in sentences if "team" in s.lower()), "")
    profile = {"About Us (including locations)": about + ".", "Our Team": team}
    return {"completion": json.dumps({"content": {"profile": profile}})}


def lenient_fallback_model(prompt: str) -> dict:
    """Fallback stand-in: always answers with a minimal valid JSON object."""
    return {"completion": json.dumps({"content": {"profile": {"Our Culture": "Not stated"}}})}
