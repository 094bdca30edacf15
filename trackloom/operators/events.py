"""Event subscriptions and fan-out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

log = logging.getLogger(__name__)

# Event classes and the type text of each: fixed values.
EVENT_CLASSES = {
    "TargetCreatedEvent": "target.created", "TargetLostEvent": "target.lost",
    "TargetRecoveredEvent": "target.recovered", "TargetLockedEvent": "target.locked",
    "TargetRemovedEvent": "target.removed",
}


def matches(key: str) -> Column:
    """Condition of a subscription: ``*``, an event type, or a class name.

    A class matches typed rows only; an untyped row with the same text does not count.
    """
    if key == "*":
        return F.lit(True)
    if key in EVENT_CLASSES:
        return F.col("typed") & (F.col("event_type") == EVENT_CLASSES[key])
    return F.coalesce(F.col("event_type") == key, F.lit(False))


def subscribe(events: DataFrame, key: str) -> DataFrame:
    return events.filter(matches(key))


def delivered_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Number of subscriptions each event reaches."""
    hits = sum((matches(k).cast("int") for k in keys), F.lit(0))
    return events.withColumn("delivered", hits)


def route(events: DataFrame, sinks: dict[str, tuple[str, Callable[[DataFrame], None]]]) -> dict[str, str]:
    """Write each sink's share of a batch; a sink that fails does not stop the others.

    ``sinks`` maps a name to (subscription key, write function). Returns the failures by name.
    """
    failed = {}
    for name, (key, write) in sinks.items():
        try:
            write(subscribe(events, key))
        except Exception as exc:  # isolation between sinks
            log.warning("sink %s failed: %s", name, exc)
            failed[name] = str(exc)
    return failed


def route_stream(events: DataFrame, sinks: dict[str, tuple[str, Callable[[DataFrame], None]]], checkpoint: str,
                 dead_letters: str | None = None):
    """Route every micro-batch. The share of a sink that fails goes to ``dead_letters`` (a parquet folder) with the
    sink's name, the batch number and the error; without that folder the batch fails and is delivered again."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            failed = route(batch, sinks)
            if failed and dead_letters is None:
                raise RuntimeError(f"sinks failed: {failed}")
            for name, why in failed.items():
                lost = subscribe(batch, sinks[name][0])
                lost.withColumns({"sink": F.lit(name), "batch": F.lit(number), "error": F.lit(why[:1000])}).write.mode("append").parquet(dead_letters)
        finally:
            batch.unpersist()

    return (events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
