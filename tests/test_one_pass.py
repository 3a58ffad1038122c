"""What the rules find beside a document's text: no shuffle, no window, and the same as in rows."""
from pyspark.sql import functions as F

from medlattice.operators import context, extract, sections, weak
from medlattice.plans import queries
from medlattice.sources import writers
from tests.test_clinical import NOTE, notes, rows

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_shuffle_nothing(spark):
    d = notes(spark, NOTE, "", NOTE * 2)
    a = extract.annotate(d)
    for df in (extract.extract(d), sections.segment(d), sections.placed_lines(d), context.asserted(a), weak.cleaned(a), weak.labelled_chunks(a, 100), weak.well_grounded(a, 1), writers.records(a)):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)


def test_queries_read_the_notes_once(spark):
    for name in ("cover_check", "section_asof", "denoised_concepts", "quality_notes", "learned_assertions", "labelled_windows", "output_records", "assertion_examples", "context_assertions", "evaluation"):
        assert plan(queries.QUERIES[name](spark, SMALL)).count("lineitem.parquet") == 1, name


def test_beside_and_rows_agree(spark):
    d = notes(spark, NOTE, "", NOTE.replace("\n", "\r\n"), "Chẩn đoán: (a), gout (nhẹ); gout (nhẹ)\n")
    c, a = extract.extract(d), extract.annotate(d)
    key = ("doc_id", "start", "end", "type", "text")
    assert rows(weak.clean_concepts(c, d), *key) == rows(extract.flat(weak.cleaned(a)), *key)
    assert rows(weak.chunk_labelled(d, c, 60), "doc_id", "window", "text") == rows(weak.labelled_chunks(a, 60), "doc_id", "window", "text")
    assert rows(context.add_assertions(c, d), *key, "assertions") == rows(context.asserted(a), *key, "assertions")
    assert rows(weak.quality_filter(d, c, 3), "doc_id") == rows(weak.well_grounded(a, 3), "doc_id") == [(0,), (2,), (3,)]
    bad = d.join(sections.cover_errors(d, sections.segment(d)), "doc_id")
    assert bad.count() == 0 and sections.cover_errors(d, sections.segment(d).where("char_start > 0 or doc_id = 1")).count() == 3
    assert a.where(F.size("concepts") > 0).count() == 3


def test_labelling_shuffles_candidates_only(spark):
    """Runs meet the dictionary by their whole key; no token is ordered in a window, and the bitmap loses no term."""
    none = spark.createDataFrame([], "ord bigint, term string")
    terms = spark.createDataFrame([(i, f"bệnh số{i} x") for i in range(500)], "ord bigint, term string")
    kb = spark.createDataFrame([], "prio int, ord bigint, code string, term string")
    d = spark.createDataFrame([(i, f"có (Bệnh  số{i} x), rồi bệnh số{i}") for i in range(500)], "doc_id bigint, raw string")
    got = weak.distant_label(d, weak.term_index(kb, kb, terms, none))
    assert "ahead" not in plan(got)  # the list of tokens ahead, once carried and shuffled with every token
    assert rows(got, "doc_id", "start", "text") == [(i, 4, f"Bệnh  số{i} x") for i in range(500)]


def test_numbers_are_found_without_a_fold(spark):
    d = notes(spark, "a -1,234.50 b 3,5; +7 x١", "", "1,000 12,34")
    got = queries._spans(d, queries.text.find_numbers(F.col("raw")))
    assert "aggregate(" not in plan(got)
    assert rows(got, "doc_id", "start", "end_", "kind", "value") == [(0, 2, 11, "thousands", -1234.5), (0, 14, 17, "decimal", 3.5), (0, 19, 21, "int", 7.0), (2, 0, 5, "thousands", 1000.0), (2, 6, 11, "decimal", 12.34)]
