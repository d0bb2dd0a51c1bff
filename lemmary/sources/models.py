"""Model calls as injected callables over Arrow batches; nothing here loads a model."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructType


class Allowance:
    """Calls that may begin: ``rate`` a second on average, ``burst`` at once. Threads share one."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if rate <= 0 or burst < 1:
            raise ValueError("an allowance needs a rate above 0 and a burst of 1 or more")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.left, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        """Wait until one more call may begin. The place in line is taken at once, so waiting threads do not overtake."""
        with self.lock:
            now = self.clock()
            self.left = min(float(self.burst), self.left + (now - self.at) * self.rate) - 1
            self.at = now
            wait = -self.left / self.rate
        if wait > 0:
            self.sleep(wait)


def answer(
    frame: DataFrame, prompt: str, call: Callable[[list[str]], list[str]], out: str = "answer", tries: int = 3, pause: float = 1.0,
    size: int | None = None, threads: int = 1, per_second: float | None = None, tasks: int | None = None,
) -> DataFrame:
    """Add an answer to each prompt: a call for each ``size`` prompts (a batch without it), ``threads`` calls at once in a task.

    ``tasks`` bounds the tasks that call at the same time. ``per_second`` bounds
    the calls that all of them begin, tries included: each has an equal share,
    so it needs ``tasks``. A connection that fails is tried again after growing
    pauses and then ends the job; any other error becomes the text "ERROR: ..."
    of its call's prompts. An empty frame makes no call.
    """
    if per_second is not None and tasks is None:
        raise ValueError("per_second is shared out over tasks: give their number")
    names = frame.columns
    schema = StructType([*frame.schema.fields]).add(out, StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowance = Allowance(per_second / tasks, threads) if per_second is not None else None

        def said(prompts: list[str]) -> list[str]:
            for k in range(tries):
                try:
                    if allowance:
                        allowance.take()
                    return call(prompts)
                except (ConnectionError, TimeoutError):
                    if k == tries - 1:
                        raise
                    time.sleep(pause * 2**k)
                except Exception as e:  # noqa: BLE001
                    return [f"ERROR: {e}"] * len(prompts)
            return []

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                prompts = batch[prompt].tolist()
                step = size or max(len(prompts), 1)
                answers = pool.map(said, [prompts[i : i + step] for i in range(0, len(prompts), step)])
                yield batch[names].assign(**{out: [a for part in answers for a in part]})

    return (frame.coalesce(tasks) if tasks else frame).mapInPandas(run, schema)


def entail(frame: DataFrame, a: str, b: str, judge: Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]) -> DataFrame:
    """Add entailment, contradiction and neutral: the mean of a judge's scores in both directions."""
    names = ["entailment", "contradiction", "neutral"]
    own = frame.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = batch[a].fillna("").tolist(), batch[b].fillna("").tolist()
            there, back = judge(list(zip(left, right, strict=True))), judge(list(zip(right, left, strict=True)))
            mean = [[(x + y) / 2 for x, y in zip(p, q, strict=True)] for p, q in zip(there, back, strict=True)]
            yield batch[own].assign(**{n: [m[i] for m in mean] for i, n in enumerate(names)})

    schema = StructType([*frame.schema.fields])
    for n in names:
        schema = schema.add(n, DoubleType())
    return frame.mapInPandas(run, schema)
