"""Loops to a fixed point, deadlines, and what of a result has to be made again."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberloom.scratch import discard, settle


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, most_rounds: int = 64) -> DataFrame:
    """``step`` applied until no row differs from the round before; an error if that takes more than ``most_rounds``.

    Each state is settled, so a round's plan is one step long; one count a round reaches the driver.
    """
    now = settle(state, "fixpoint")
    for _ in range(most_rounds):
        after = settle(step(now), "fixpoint")
        values = [c for c in after.columns if c != key]
        mark = lambda df, name: df.select(key, F.xxhash64(*values).alias(name))  # noqa: B023, E731
        changed = mark(now, "_a").join(mark(after, "_b"), key, "full_outer").where("not (_a <=> _b)").limit(1).count()
        if not changed:
            discard(after)
            return now
        discard(now)
        now = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


class DeadlineExceeded(TimeoutError):
    """The jobs of an action were cancelled because its time was over."""


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """What ``action`` returns; its jobs are cancelled and DeadlineExceeded is raised if it takes longer."""
    context, group, over = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(group)

    context.addJobTag(group)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"not done after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(group)


def to_recompute(modules: DataFrame, changed: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, module): what has to be made again after some modules changed, by each query's granularity.

    ``modules`` has (module, context), ``changed`` (module), ``queries`` (query, granularity).  ``module``: the changed ones;
    ``context``: all that share a context with a changed one; ``global``: all modules, once anything changed.
    """
    contexts = modules.join(changed, "module", "left_semi").select("context").distinct()
    sets = {"module": modules.join(changed, "module", "left_semi"), "context": modules.join(contexts, "context", "left_semi"), "global": modules if not changed.isEmpty() else modules.limit(0)}
    parts = [df.select(F.lit(g).alias("granularity"), "module") for g, df in sets.items()]
    return queries.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "granularity").select("query", "module")


def demanded(facts: DataFrame, targets: DataFrame, on: str) -> DataFrame:
    """The facts that a target asks for; none are read where no target is left."""
    return facts.join(targets.select(on).distinct(), on, "left_semi")


def first_of(*choices: Column) -> Column:
    """The first choice that gives something: a chain of providers."""
    return F.coalesce(*choices)
