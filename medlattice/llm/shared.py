"""Helpers that the operators of this subpackage share: tables in the shared folder, free names, blocks of texts.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which every executor of a cluster can read, so a lost
executor only costs the re-reading of files.  A machine-local folder is used only where driver and executors are one
process and that setting is absent (tests); a cluster without the setting is an error.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only when spark.checkpoint.dir is unset and everything runs in this process, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/medlattice"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return FALLBACK_DIR


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def drop_shared(table: DataFrame | None) -> None:
    """Remove a table of ``shared_table`` that no later plan reads."""
    path = getattr(table, "_shared_path", None)
    if path:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until it is none of ``taken`` (case ignored, as Spark does)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_flag(doc_id, modulus: int, held_out_remainder: int):
    """True for held-out rows: crc32 of the decimal doc_id leaves the given remainder. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) == held_out_remainder


def blocks(texts: list, max_chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` with at most ``max_chars`` characters each, or a single longer text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > max_chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list | pa.Array]], schema: str, slice_rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``slice_rows`` rows: columns as Python lists in, columns out.

    ``fn`` may return more or fewer rows than it got.  Slicing bounds the Python worker's memory whatever the batch size.
    """
    from pyspark.sql.types import _parse_datatype_string  # type: ignore[attr-defined]
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, slice_rows):
                part = batch.slice(lo, slice_rows)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out is None:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)
