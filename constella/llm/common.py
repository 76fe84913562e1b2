"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.session import prepare, table_path

#: White space of the word contract: the byte class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t-\\r]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def join_small(big: DataFrame, small: DataFrame, key: str, bound: int = 50_000, salts: int = 64) -> DataFrame:
    """Inner join of ``big`` with one row per key of ``small``.

    ``small`` is broadcast only when it is counted to hold at most ``bound``
    rows. Beyond that the join is salted: every row of ``small`` is repeated
    per salt and ``big`` spreads its rows over the salts, so a key with a third
    of all rows is shared by ``salts`` tasks."""
    if small.limit(bound + 1).count() <= bound:
        return big.join(F.broadcast(small), key)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("__salt", (F.rand(17) * salts).cast("int"))
    return spread.join(salted, [key, "__salt"]).drop("__salt")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes partition counts, nothing else."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def share(spark: SparkSession, thing):
    """A function that gives ``thing`` on executors. It is broadcast once (its
    size must be bounded by the caller) and unpacked once a Python worker, so
    what it remembers stays from task to task."""
    from pyspark import cloudpickle

    held = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})

    def get():
        box = held.value
        if "thing" not in box:
            from pyspark import cloudpickle

            box["thing"] = cloudpickle.loads(box["packed"])
        return box["thing"]

    return get


def give_back() -> None:
    """Hands memory that earlier tasks of this Python worker freed back to the
    system: workers live on from stage to stage, and what one stage needed
    should not stay with them through the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to hand back
        pass
