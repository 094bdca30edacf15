"""The snapshot JSON feed and snapshot sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import once
from ..schemas import SNAPSHOT_OPTIONAL, SNAPSHOT_REQUIRED, SNAPSHOTS_DDL


def to_snapshot_json(df: DataFrame, sort_keys: bool = False) -> DataFrame:
    """One JSON text per snapshot; null fields are written, as the reader requires them."""
    fields = [c for c, _ in SNAPSHOT_REQUIRED + SNAPSHOT_OPTIONAL if c in df.columns]
    if sort_keys:
        fields = sorted(fields)
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def parse_snapshots(df: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable snapshots and, apart, the rejected lines with a reason.

    Unknown keys are ignored. A line is rejected when it is no JSON object, lacks a required key,
    or carries a metadata entry that is null or no object.
    """
    # each step goes through a generator, so that neither the text nor its keys are worked out again for every use
    lines = once(df, _raw=F.col(text))
    raw, keys, meta = F.col("_raw"), F.col("_keys"), F.col("_meta")
    lines = once(lines, _keys=F.json_object_keys(raw), _meta=F.get_json_object(raw, "$.metadata"))
    required = F.array(*[F.lit(c) for c, _ in SNAPSHOT_REQUIRED])
    reason = (F.when(keys.isNull(), "not a JSON object")
              .when(F.size(F.array_except(required, keys)) > 0, "missing required field")
              .when(F.array_contains(keys, "metadata") & (meta.isNull() | ~meta.startswith("{")),
                    "metadata must be an object"))
    marked = once(lines, _reason=reason)
    empty = F.create_map().cast("map<string,string>")
    good = (once(marked.filter("_reason IS NULL").select("_raw"), s=F.from_json(raw, SNAPSHOTS_DDL)).select("s.*")
            .withColumns({"metadata": F.coalesce("metadata", empty),
                          "attributes": F.coalesce("attributes", empty)}))
    bad = marked.filter("_reason IS NOT NULL").select(*df.columns, F.col("_reason").alias("reason"))
    return good, bad


def check_snapshot_type(df: DataFrame) -> None:
    """Raise before any write when a required field is missing or has another type."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')}" for c, t in SNAPSHOT_REQUIRED if have.get(c) != t]
    if wrong:
        raise TypeError("not a snapshot table: " + ", ".join(wrong))


def publish(df: DataFrame, sink: str, path: str | None = None, order: list[Column] | None = None) -> None:
    """Write a batch of snapshots in time order to ``parquet``, ``json`` or ``noop``."""
    check_snapshot_type(df)
    rows = df.repartitionByRange(*(order or [F.col("timestamp")])).sortWithinPartitions(
        *(order or [F.col("timestamp")]))
    writer = rows.write.format(sink).mode("overwrite" if sink == "noop" else "append")
    writer.save(path) if path else writer.save()
