"""What the operators of this subpackage share: intermediate tables, Arrow maps, fresh column names, tokenizer files."""

from __future__ import annotations

import functools
import gc
import math
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from straitline.session import scratch_folder


#: Rows that a worker holds as Python objects at a time.
ROWS = 500


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the cluster's shared folder and read again: lineage ends there, and Spark knows its size."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffles of finished jobs: those that neither Python nor the JVM refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables whose readers are all done, and the shuffles that went with them.

    Whatever is still needed must have been stored since: nothing can be computed anew from a table that is gone.
    """
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores in front as it takes to differ from every column there is."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_map(df: DataFrame, fn: Callable[..., Iterator], schema: str | StructType) -> DataFrame:
    """Apply ``fn(*columns)`` to the columns of each Arrow batch, as lists; it returns the result's columns, as lists or arrays."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        out = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                columns = fn(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type, from_pandas=True) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, kind)


_holders: dict[str, Callable[[], None]] = {}


def hold_alone(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Let ``owner`` be the one operator that this worker process remembers things for; what others remember is cleared.

    Workers outlive their tasks and serve one stage after the other, so that their caches would otherwise add up.
    """
    for other in [x for x in _holders if x != owner]:
        _holders.pop(other)()
        pa.default_memory_pool().release_unused()
    _holders[owner] = clear


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def row_key(df: DataFrame) -> Column:
    """A 64-bit key of a row's whole content; repeated rows share it."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


def rows_per_part(spark: SparkSession, rows: int, size: int) -> int:
    """How many parts hold ``rows`` at about ``size`` rows each."""
    return max(1, math.ceil(rows / size))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; ``TOKENIZER_DIR`` overrides the installed package, and full paths stay as they are."""
    if os.path.isabs(name):
        return name
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizer of the ``tokenizers`` library, one per worker process; its special strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer
