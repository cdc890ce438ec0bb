"""Helpers that the operators share: intermediate tables, batches of bounded size, hashes of words."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker holds in unpacked form at once; a longer text is a chunk of its own.
CHUNK_BYTES = 6_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; a temporary folder only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/factloom/{uuid.uuid4().hex}"


def materialised(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    The shuffle files behind what is written are of no more use; Spark deletes them once the driver's JVM collects the
    garbage that names them, which a small driver heap does often and a large one hardly ever, so it is asked to.
    Compiling plans also leaves much freed memory outside the heap, which the C library keeps unless it is asked, too.
    """
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    gc.collect()
    if (jvm := getattr(df.sparkSession, "_jvm", None)) is not None:
        jvm.System.gc()
        trim(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM hand freed native memory back to the system; False where it can't (not HotSpot, not glibc)."""
    gateway = spark.sparkContext._gateway
    jvm, of = gateway.jvm, gateway.jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = of(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by reflection on the interface, as the server's own class isn't open to others
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
        return True
    return False


def discard(table: DataFrame) -> None:
    """Frees the files of a table of ``materialised`` that no unfinished result reads any more."""
    table.limit(0).write.mode("overwrite").parquet(f"{table.stored_at}.none")
    table.sparkSession.read.schema(table.schema).parquet(f"{table.stored_at}.none").write.mode("overwrite").parquet(table.stored_at)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whatever the columns' names: Spark can't resolve some, such as those with a dot."""
    names = df.columns
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(ids: Iterable, texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Consecutive (ids, texts) whose texts together have about ``limit`` bytes at most, or one text."""
    a: list = []
    b: list[bytes] = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        if a and size + len(t) > limit:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(t)
        size += len(t)
    if a:
        yield a, b


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """``chunks`` of record batches whose columns are an id and a text; a null text is empty."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield from chunks(batch.column(0).to_pylist(), [t or b"" for t in texts], limit)


def encode_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order of the texts, words in each text).

    Words are ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split`` without an argument gives.
    """
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = t.split()
        counts[k] = len(own)
        words += own
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), counts


def ragged(flat: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of ``flat``'s pieces (of ``lengths``) at ``pick``, and the length of each picked piece."""
    offsets = np.cumsum(lengths) - lengths
    got = lengths[pick]
    ends = np.cumsum(got)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[pick] - (ends - got), got) + np.arange(total)], got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def rolling(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each window of ``width`` word hashes; the result has ``len(h) - width + 1`` values (none if negative)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(odd_constants(width, seed)):
        out += h[j : j + n] * c
    return mix(out)
