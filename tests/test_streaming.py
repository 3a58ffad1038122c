from medlattice.operators.extract import extract
from medlattice.sources.readers import read_documents
from medlattice.streaming.extraction import extract_stream, stream_documents
from tests.test_clinical import NOTE


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text(NOTE.replace("gout", f"gout {i}"), encoding="utf-8")
    q = extract_stream(stream_documents(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda df: sorted((r["doc_id"], r["start"], r["text"], r["type"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(extract(read_documents(spark, str(tmp_path / "in"))))
