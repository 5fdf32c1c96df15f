"""Batch inference through a user-supplied function.

``fn(list[str]) -> list[str]`` (a model client, a local model, …) is applied with ``mapInPandas``: the function
is built once per task, called on slices of at most ``batch_size`` prompts, retried up to ``attempts`` times with
a random exponential wait. A slice that still fails is asked again prompt by prompt, so one bad prompt does not fail
its neighbours; what fails alone gives a row with ``error`` set instead of failing the job.

Spark may run a task more than once (retries, lost executors, recomputation), so calls can repeat. Pipelines
that must not call twice write the answers to the cache table first and read them back downstream
(:func:`infer_to_cache`), or commit them slice by slice while they are made (:mod:`textlake.operators.answer_log`).
"""

from __future__ import annotations

import random
import time
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, give_back

# Attempts per call and the longest wait between attempts (seconds) of the original tool.
ATTEMPTS = 3
MAX_WAIT_SECONDS = 10.0


def _call_with_retry(fn, prompts, attempts, max_wait, sleep):
    last = None
    for attempt in range(attempts):
        try:
            out = fn(prompts)
            if len(out) != len(prompts):
                raise ValueError(f"model returned {len(out)} answers for {len(prompts)} prompts")
            return [None if x is None else str(x) for x in out], None
        except Exception as e:  # noqa: BLE001 - any model failure is retried, then recorded
            last = e
            if attempt + 1 < attempts and max_wait > 0:
                sleep(random.uniform(0, min(max_wait, 2 ** attempt)))
    return [None] * len(prompts), f"{type(last).__name__}: {last}"


def ask(fn, prompts: list, batch_size: int, attempts: int, max_wait: float, sleep=time.sleep) -> tuple[list, list]:
    """Responses and errors of ``prompts``, asked in slices; a slice that fails is asked again prompt by prompt."""
    responses, errors = [], []
    for i in range(0, len(prompts), batch_size):
        part = prompts[i:i + batch_size]
        out, err = _call_with_retry(fn, part, attempts, max_wait, sleep)
        if err is not None and len(part) > 1:
            alone = [_call_with_retry(fn, [p], attempts, max_wait, sleep) for p in part]
            responses += [r for (r,), _e in alone]
            errors += [e for _r, e in alone]
        else:
            responses += out
            errors += [err] * len(part)
    return responses, errors


def batch_infer(prompts: DataFrame, make_fn: Callable[[], Callable[[list], list]], *, key_cols,
                prompt_col: str = "prompt", batch_size: int = 16, attempts: int = ATTEMPTS,
                max_wait: float = MAX_WAIT_SECONDS, num_partitions: int | None = None) -> DataFrame:
    """``*key_cols, response, error`` per prompt row.

    ``key_cols`` are carried through unchanged (any columns a later step needs, so that the answers never have
    to be joined back to their prompts: a join would branch the plan and could call the model twice). A NULL
    prompt gets a NULL response without a model call. Prompts reach a task in batches bounded by bytes.
    """
    bound_batches(prompts.sparkSession)
    keys = list(key_cols)
    src = prompts.select(*keys, prompt_col)
    if num_partitions:
        src = src.repartition(int(num_partitions), *keys)
    by_name = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join(f"`{k}` {by_name[k]}" for k in keys) + ", response string, error string"
    bs = int(batch_size)

    def run(batches):
        fn = make_fn()
        for pdf in batches:
            texts = pdf[prompt_col].tolist()
            todo = [i for i, t in enumerate(texts) if t is not None]
            responses, errors = [None] * len(texts), [None] * len(texts)
            for j, r, e in zip(todo, *ask(fn, [texts[j] for j in todo], bs, attempts, max_wait), strict=True):
                responses[j], errors[j] = r, e
            res = pdf[keys].copy()
            res["response"] = pd.Series(responses, index=pdf.index, dtype=object)
            res["error"] = pd.Series(errors, index=pdf.index, dtype=object)
            yield res
            give_back()

    return src.mapInPandas(run, schema)


def infer_to_cache(prompts: DataFrame, cache: DataFrame, cache_path: str, make_fn, as_of, *, key_col: str = "cache_key",
                   prompt_col: str = "prompt", **kw) -> DataFrame:
    """``*prompts, response, error`` for every prompt: from the live cache, else from one call per distinct missing key.

    The calls' results are written once (downstream steps never trigger a second call); answers are also appended to
    ``cache_path``. A failed prompt keeps its row with ``error`` set and is not cached."""
    from ..session import materialize
    from .cache import live, misses

    todo = misses(prompts.select(key_col, prompt_col).dropDuplicates([key_col]), cache, as_of, key_col)
    fresh = materialize(batch_infer(todo, make_fn, key_cols=[key_col], prompt_col=prompt_col, **kw), "inferred")
    ok = fresh.filter(F.col("error").isNull()).select(
        F.col(key_col).alias("cache_key"), "response",
        (F.lit(as_of) if not isinstance(as_of, str) else F.to_timestamp(F.lit(as_of))).cast("timestamp").alias("ts"))
    ok.write.mode("append").parquet(cache_path)
    known = live(cache, as_of).select(F.col("cache_key").alias(key_col), "response",
                                      F.lit(None).cast("string").alias("error"))
    return prompts.join(known.unionByName(fresh.select(key_col, "response", "error")), key_col, "left")
