"""What several operators of this subpackage share: reading, shipping, cutting lineage."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lineament.functions.shipping import ship
from lineament.functions.written import Written

__all__ = ["BATCH_ROWS", "Cut", "enrich", "free", "fresh", "named", "ship", "slices", "table"]

#: Rows that become Python objects at once; texts may be very long, so these are few.
#: (An Arrow batch has more, bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch.)
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch while a table is written.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """For one action: Arrow batches of at most BATCH_BYTES. The session's own bound is there again afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Cut(Written):
    """A table written to the shared folder, in short batches, and read again; ``drop`` removes it.

    Frames that are returned to a caller read theirs whenever they run, so what is
    left is removed at the end of the program."""

    def __init__(self, df: DataFrame, name: str):
        with short_batches(df.sparkSession):
            super().__init__(df, name)


def free(taken: Iterable[str], names: Iterable[str]) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from
    ``taken`` and from those before it (Spark compares without case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    return free(df.columns, [name])[0]


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; a batch is let go before the next one is read."""
    every = iter(batches)
    while (batch := next(every, None)) is not None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch


def enrich(
    df: DataFrame,
    column: str,
    factory: Callable[[], Callable[[list], Sequence[pa.Array]]],
    fields: Sequence[StructField],
    keep: Sequence[str],
) -> DataFrame:
    """Keep ``keep`` and add ``fields``, made in Python from the values of ``column``.

    ``factory`` runs once a task and returns a function from a list of values to
    one Arrow array a field. Rows stay in their partitions: nothing is shuffled,
    and a task holds the Python objects of ``BATCH_ROWS`` rows at a time. A field
    whose name is kept already is renamed as ``free`` does.
    """
    spark = df.sparkSession
    ship(spark)
    kept = df.select(*map(named, keep))
    inner = [StructField(f"c{i}", f.dataType, True) for i, f in enumerate([*kept.schema, *fields])]
    schema, count = StructType(inner), len(kept.columns)
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = factory()
        for batch in slices(batches):
            made = work(batch.column(count).to_pylist())
            columns = [batch.column(i) for i in range(count)]
            yield pa.RecordBatch.from_arrays(
                [x if x.type == f.type else x.cast(f.type) for x, f in zip([*columns, *made], arrow)], schema=arrow
            )

    given = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(column).alias(f"c{count}"))
    return given.mapInArrow(run, schema).toDF(*keep, *free(keep, [f.name for f in fields]))
