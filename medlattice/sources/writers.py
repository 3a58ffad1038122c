"""Sinks (S4, S11, S12, O1): records, JSON lines, one JSON file a document, zip."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import LINKABLE
from ..functions.text import is_grounded


def scratch_path(spark, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``), or in a local one where there is one process only."""
    import uuid

    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(folder or 'file:///tmp/checkpoints/medlattice').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if "://" in path:
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # a path without a scheme belongs to the default file system
    whole = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def records(annotated: DataFrame) -> DataFrame:
    """O1 for documents with their concepts beside them."""
    good = F.filter("concepts", lambda c: is_grounded(F.col("raw"), c["text"], c["start"], c["end"]))
    ordered = F.array_sort(F.transform(good, lambda c: F.struct(c["start"], c["end"], c["ord"], c.alias("c"))))

    def record(x):
        c = x["c"]
        return F.struct(c["text"].alias("text"), F.array(c["start"], c["end"]).alias("position"), c["type"].alias("type"), c["assertions"].alias("assertions"), F.when(c["type"].isin(LINKABLE), c["candidates"]).alias("candidates"))

    made = annotated.select("doc_id", F.transform(ordered, record).alias("records"))
    return made.select("doc_id", F.coalesce("records", F.array().cast(made.schema["records"].dataType)).alias("records"))


def to_records(concepts: DataFrame, docs: DataFrame) -> DataFrame:
    """O1: one row per document: doc_id, records (JSON objects in order of position, ungrounded ones dropped, no de-duplication).

    ``candidates`` is a key only of linkable types: null fields are left out of JSON.
    """
    from ..operators.extract import beside

    own = concepts.select("doc_id", "ord", "text", "type", "start", "end", "assertions", "candidates")
    return records(beside(docs.select("doc_id", "raw"), own))


def write_labelled(docs: DataFrame, path: str) -> None:
    """JSON lines of doc_id, text, concepts (start and end become position)."""
    c = lambda x: F.struct(x["text"], x["type"], F.array(x["start"], x["end"]).alias("position"), x["assertions"], x["candidates"])
    docs.select(F.to_json(F.struct("doc_id", "text", F.transform("concepts", c).alias("concepts"))).alias("value")).write.text(path)


def write_json_files(records: DataFrame, path: str) -> int:
    """One ``<id>.json`` a document, its array with an indent of 2, written by the executors below ``path``; the number of files.

    ``path`` is a URI that every executor can write or, in local mode only, a plain folder.
    """
    import json

    import pyarrow as pa

    if "://" not in path and not records.sparkSession.conf.get("spark.master", "").startswith("local"):
        raise ValueError("a cluster needs a URI that every executor can write")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        store.create_dir(root)
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_output_stream(f"{root}/{name}.json") as f:
                    f.write(json.dumps(json.loads(text), ensure_ascii=False, indent=2).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = records.select(F.col("doc_id").cast("string").alias("doc_id"), F.to_json("records").alias("v"))
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_zip(records: DataFrame, path: str) -> int:
    """``output/<id>.json`` entries in one archive on the driver, streamed document by document."""
    import json
    import zipfile

    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in records.select("doc_id", F.to_json("records").alias("v")).toLocalIterator():
            z.writestr(f"output/{r['doc_id']}.json", json.dumps(json.loads(r["v"]), ensure_ascii=False, indent=2))
            n += 1
    return n
