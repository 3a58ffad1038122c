"""Scalars: normalisation, search, trimming, numbers, mark-up, metrics."""
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medlattice.functions import fuzzy, metrics, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(s):
    return F.lit(s)


def test_normalisation_keeps_length(spark):
    for s, expected in [("Đường HUYẾT", "duong huyet"), ("ÀÉÎõü", "aeiou"), ("ﬁ İ", None), ("", "")]:
        got = one(spark, text.normalize(lit(s)))
        assert len(got) == len(s)
        if expected is not None:
            assert got == expected


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_literal_normalisation_keeps_length(s):
    assert len(text.normalize_literal(s)) == len(s)


def test_find_all_takes_text_from_raw(spark):
    raw = "Đau  bụng, đau bụng"
    got = one(spark, text.find_all(lit(raw), "dau bung"))
    assert [(m["start"], m["end"]) for m in got] == [(0, 9), (11, 19)]
    assert all(raw[m["start"] : m["end"]] == m["raw"] for m in got)
    assert one(spark, text.find_all(lit(raw), "  ")) == []
    assert one(spark, text.find_all(lit("họng hò ho"), "ho", whole_word=True))[-1]["start"] == 8
    assert one(spark, text.first_match(text.find_all(lit(raw), "dau bung"), 1))["start"] == 11
    assert one(spark, text.first_match(text.find_all(lit(raw), "dau bung"), 12)) is None
    column = one(spark, text.find_all(lit(raw), lit("dau bung")))
    assert [(m["start"], m["end"]) for m in column] == [(0, 9), (11, 19)]


def test_grounding(spark):
    for t, s, e, ok in [("bc", 1, 3, True), ("bc", 1, 4, False), ("x", 7, 8, False), ("", 2, 2, True), ("bc", 3, 1, False)]:
        assert one(spark, text.is_grounded(lit("abcd"), lit(t), F.lit(s), F.lit(e))) is ok


def test_trimming_moves_the_start(spark):
    raw = " -- đau (a) (b). "
    t, s = text.strip_span(lit(raw), F.lit(0))
    got, start = one(spark, t), one(spark, s)
    assert raw[start : start + len(got)] == got
    t, s = text.trimmed(lit("\t; ho khan .,"), F.lit(10))
    assert (one(spark, t), one(spark, s)) == ("ho khan", 13)
    t, s = text.strip_span(lit("viêm phổi (trái) [cũ]"), F.lit(0))
    assert one(spark, t) == "viêm phổi"
    t, s = text.strip_span(lit("(chỉ có ngoặc)"), F.lit(0))
    assert one(spark, t) != ""


def test_numbers(spark):
    got = one(spark, text.find_numbers(lit("Na 13,5; plt 150,000; hr 88; x -0.5")))
    assert [(n["raw"], n["kind"], n["value"]) for n in got] == [("13,5", "decimal", 13.5), ("150,000", "thousands", 150000.0), ("88", "int", 88.0), ("-0.5", "decimal", -0.5)]
    got = one(spark, text.find_ranges(lit("ure 9.1->7.4; 2-3 ngày; 1 — 2")))
    assert [(r["a"], r["b"]) for r in got] == [(9.1, 7.4), (1.0, 2.0)]
    assert one(spark, text.looks_like_measurement(lit(" kali 3 "))) is True
    assert one(spark, text.looks_like_measurement(lit("x" * 81 + "1"))) is False
    assert [one(spark, c) for c in text.dose(lit("salbutamol 2,5mg po"))] == ["salbutamol ", "2.5", "mg"]


def test_marked_text(spark):
    got = one(spark, text.parse_marked(lit('a <c type="THUỐC" a="isNegated, x">aspirin</c> b <c type="SAI">q</c>')))
    assert got["text"] == "a aspirin b q"
    assert [(c["text"], c["start"], c["end"], c["assertions"]) for c in got["concepts"]] == [("aspirin", 2, 9, ["isNegated"])]
    assert one(spark, text.mark(lit("abcdef"), F.lit(2), F.lit(4), 1, 1)) == "b [E] cd [/E] e"
    assert one(spark, text.multi_hot(F.array(lit("isFamily")))) == [0.0, 0.0, 1.0]


def test_fuzzy_ratio():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for a, b in [("benh su", "benh su hien tai"), ("abc", ""), ("kitten", "sitting"), ("aaa", "aa")]:
        assert fuzzy.lcs(a, b) == slow(a, b)
    assert round(fuzzy.ratio("benh su hien tai", "benh su hien tai"), 6) == 100.0


def test_metrics(spark):
    words = lambda s: F.array(*[F.lit(w) for w in s.split()]) if s else F.array().cast("array<string>")
    assert one(spark, metrics.edit_distance(words("k i t t e n"), words("s i t t i n g"))) == 3
    assert one(spark, metrics.edit_distance(words(""), words("a b"))) == 2
    assert one(spark, metrics.wer(lit("a b"), lit("a b c d e"))) == 1.5
    assert one(spark, metrics.wer(lit(""), lit(""))) == 0.0 and one(spark, metrics.wer(lit(" "), lit("a"))) == 1.0
    for g, p, x in [("", "", 1.0), ("", "x", 0.0), ("x", "", 0.0), ("a b", "b c", 1 / 3)]:
        assert abs(one(spark, metrics.jaccard(words(g), words(p))) - x) < 1e-12


def test_map_agrees_with_unicode_rules(spark):
    for c in "ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ":
        base = unicodedata.normalize("NFD", c)[0]
        assert one(spark, text.normalize(lit(c))) == base


def test_settings_from_files(tmp_path):
    from medlattice.functions.config import CUES, SECTIONS
    from medlattice.functions.settings import Settings, load

    files = {"t": "rules:\n  max_len: 7\n  unknown: 1\nlink:\n  fuzzy_threshold: 80\n", "s": "SYMPTOM:\n  - Triệu chứng\n", "c": "isFamily:\n  - ông\n", "e": ""}
    for name, body in files.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    got = load(*[str(tmp_path / n) for n in "tsc"])
    assert (got.max_len, got.fuzzy_threshold, got.neg_window) == (7, 80, Settings().neg_window)
    assert got.sections == {"SYMPTOM": ["trieu chung"]} and got.cues == CUES | {"isFamily": ["ông"]}
    assert load() == Settings() and load(str(tmp_path / "e")).sections == SECTIONS
