"""Model calls that can be taken up again (L2, L6, L8, X9 limits).

A model call costs money and time, so each distinct prompt is asked once and
its answer is kept: prompts are de-duplicated by their hash, answers are
appended to a Parquet table under that hash, and only prompts without a good
answer there are asked. The work is cut into a few commits by hash. A run
that is lost half-way keeps the answers of the commits before, and the next
run asks the rest. Within a commit, a task that is tried again asks its own
prompts again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import MAX_INPUT_TOKENS, MAX_OUTPUT_TOKENS
from ..session import materialize
from .llm import ModelFn, call_model, estimate_tokens, parse_completion

ANSWERS = "prompt_hash string, model string, completion string, has_completion boolean, call_error string, asked_at timestamp"


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers table; empty where nothing has been asked yet."""
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)


def answer_error(max_output_tokens: int) -> Column:
    """What is wrong with an answer: the call failed, it does not parse, or it is over the output limit; else null."""
    return F.coalesce(
        "call_error", parse_completion("completion", "has_completion")["error"],
        F.when(estimate_tokens("completion") > max_output_tokens, f"Completion exceeds {max_output_tokens} tokens"))


def ask_absent(prompts: DataFrame, model_fn: ModelFn, model: str, path: str, commits: int, tasks: int,
               max_output_tokens: int) -> None:
    """Ask ``model`` every prompt (``prompt_hash``, ``prompt``) that has no good answer of it yet; append the answers.

    The number of commits is fixed, whatever the prompts, and each is one distributed job of ``tasks`` tasks.
    """
    spark = prompts.sparkSession
    for i in range(commits):
        good = stored_answers(spark, path).filter((F.col("model") == model) & answer_error(max_output_tokens).isNull())
        todo = (prompts.filter(F.pmod(F.xxhash64("prompt_hash"), F.lit(commits)) == i)
                .join(good.select("prompt_hash"), "prompt_hash", "left_anti"))
        answers = call_model(todo.repartition(tasks, "prompt_hash"), model_fn, "prompt", model)
        answers.select("prompt_hash", "model", "completion", "has_completion", "call_error",
                       F.current_timestamp().alias("asked_at")).write.mode("append").parquet(path)


def enrich_stored(df: DataFrame, model_fn: ModelFn, path: str, fallback_fn: ModelFn | None = None,
                  prompt_col: str = "prompt", model: str = "default", fallback_model: str = "fallback",
                  commits: int = 4, tasks: int | None = None, max_input_tokens: int = MAX_INPUT_TOKENS,
                  max_output_tokens: int = MAX_OUTPUT_TOKENS) -> DataFrame:
    """``df`` with ``model``, ``result`` (VARIANT) and ``error``, as ``llm.enrich``, on answers kept at ``path``.

    A prompt that ``model`` fails on goes to ``fallback_fn``; one that both
    fail on keeps the fallback's error and is asked again by the next run. A
    prompt over ``max_input_tokens`` is not sent (error "Prompt exceeds N
    tokens"), a null prompt neither ("No prompt"). Rows with one prompt share
    one answer; each row of ``df`` comes back once. Of several answers of one
    rank the latest is taken.
    """
    spark = df.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    keyed = df.withColumn("prompt_hash", F.sha2(F.col(prompt_col), 256))
    asked = (keyed.filter(estimate_tokens(prompt_col) <= max_input_tokens)
             .select("prompt_hash", F.col(prompt_col).alias("prompt")).dropDuplicates(["prompt_hash"]))
    prompts = materialize(asked, "prompts")      # each text goes to its hash once, then every commit reads it
    ask_absent(prompts, model_fn, model, path, commits, tasks, max_output_tokens)
    error = answer_error(max_output_tokens)
    models = [model]
    if fallback_fn is not None:
        good = stored_answers(spark, path).filter((F.col("model") == model) & error.isNull())
        ask_absent(prompts.join(good.select("prompt_hash"), "prompt_hash", "left_anti"), fallback_fn, fallback_model,
                   path, commits, tasks, max_output_tokens)
        models.append(fallback_model)
    first = F.col("model") == model
    # a good answer of the first model, else of the fallback, else the fallback's failure
    rank = F.when(error.isNull(), F.when(first, 3).otherwise(2)).otherwise(F.when(first, 0).otherwise(1))
    best = (stored_answers(spark, path).filter(F.col("model").isin(models)).withColumn("answer_error", error)
            .groupBy("prompt_hash").agg(F.max_by(
                F.struct("model", "completion", "answer_error"),
                F.struct(rank, F.col("asked_at"), F.coalesce("completion", F.lit("")))).alias("a")))
    unsent = (F.when(F.col(prompt_col).isNull(), "No prompt")
              .when(estimate_tokens(prompt_col) > max_input_tokens, f"Prompt exceeds {max_input_tokens} tokens"))
    answered = unsent.isNull()
    return keyed.join(best, "prompt_hash", "left").select(
        *df.columns, F.when(answered, F.col("a.model")).alias("model"),
        F.when(answered & F.col("a.answer_error").isNull(), F.try_parse_json(F.col("a.completion"))).alias("result"),
        F.coalesce(unsent, F.col("a.answer_error")).alias("error"))
