"""Sections, extraction, context, linking, weak supervision, sequences, scoring: small notes with results worked out by hand."""
import itertools
import json

import pytest
from pyspark.sql import functions as F

from medlattice.functions.settings import Settings
from medlattice.functions.fuzzy import ratio
from medlattice.functions.text import is_grounded, normalize_literal
from medlattice.operators import context, extract, link, score, sections, sequence, weak
from medlattice.plans import jobs, synth
from medlattice.sources import readers, writers

NOTE = """1. Tiền sử bệnh
Các bệnh lý mãn tính
- gout, không đặc hiệu
* Thuốc đang dùng
- đang dùng aspirin 81 mg po điều trị đau ngực
- Ăn uống kém
2. Đánh giá tại bệnh viện
Triệu chứng hiện tại: Không sốt, ho khan: nhiều
- mẹ bị khó thở
Kết quả xét nghiệm:
kali 3,1 mmol/L; ghi chú
WBC:14,43
"""


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, raw string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sections(spark):
    d = notes(spark, NOTE, "", "chỉ có chữ\n")
    spans = sections.segment(d)
    got = rows(spans.where("doc_id = 0"), "char_start", "canonical", "doc_section")
    assert [(c, s) for _, c, s in got] == [("HISTORY_PAST", "HISTORY_PAST"), ("DIAGNOSIS", "HISTORY_PAST"), ("DRUG", "HISTORY_PAST"), ("ASSESSMENT", "ASSESSMENT"), ("SYMPTOM", "ASSESSMENT"), ("LAB", "ASSESSMENT")]
    assert rows(spans.where("doc_id = 1"), "canonical", "char_start", "char_end", "doc_section") == [("OTHER", 0, 0, "")]
    assert rows(spans.where("doc_id = 2"), "canonical", "char_start", "char_end") == [("OTHER", 0, 11)]
    assert sections.cover_errors(d.where("doc_id <> 1"), spans).count() == 0


def test_header_tiers(spark):
    texts = ["Triệu chứng hiện tại", "trieu chug hien tai", "benh su", "xyz", "", "các triệu chứng hiện tại ngày", "benh su rat dai dong khong ai biet", None]
    d = spark.createDataFrame([(t,) for t in texts], "header string")
    got = {r["header"]: (r["canonical"], round(r["confidence"], 2)) for r in sections.match_canonical(d).collect()}
    assert got["Triệu chứng hiện tại"] == ("SYMPTOM", 1.0)
    assert got["trieu chug hien tai"][0] == "SYMPTOM" and 0.88 <= got["trieu chug hien tai"][1] < 1
    assert got["benh su"] == ("HISTORY_PAST", 1.0)
    assert got["các triệu chứng hiện tại ngày"] == ("SYMPTOM", 0.99)
    assert got["benh su rat dai dong khong ai biet"] == ("HISTORY_PAST", 0.6)
    assert got["xyz"] == got[""] == got[None] == (None, 0.0)


def test_extraction(spark):
    d = notes(spark, NOTE)
    c = extract.extract(d)
    got = rows(c, "type", "text")
    assert ("THUỐC", "aspirin 81 mg po") in got and not any("uống" in t for _, t in got)
    assert ("CHẨN_ĐOÁN", "gout, không đặc hiệu") in got
    assert {("TRIỆU_CHỨNG", "sốt"), ("TRIỆU_CHỨNG", "ho khan")} <= set(got)
    assert [t for k, t in got if k == "TÊN_XÉT_NGHIỆM"] == ["WBC", "kali"] and [t for k, t in got if k == "KẾT_QUẢ_XÉT_NGHIỆM"] == ["14,43", "3,1 mmol/L"]
    marks = {r["text"]: r["assertions"] for r in c.collect()}
    assert marks["gout, không đặc hiệu"] == ["isHistorical"] and marks["sốt"] == ["isNegated"] and "isFamily" in marks["mẹ bị khó thở"] and marks["kali"] == []
    bad = c.join(d, "doc_id").where(~is_grounded(F.col("raw"), F.col("text"), F.col("start"), F.col("end")))
    assert bad.count() == 0


def test_line_breaks_keep_offsets(spark):
    raw = "a\r\nb\x0bc \n\nd"
    got = rows(sections.line_table(notes(spark, raw)), "line_start", "line")
    want, at = [], 0
    for x in raw.splitlines(keepends=True):
        want.append((at, x.rstrip("\r\n\x0b ")))
        at += len(x)
    assert got == want


@pytest.mark.parametrize("t,n", [("Không có sốt", 9), ("không rõ", 0), ("khôngsốt", 0), ("không", 5), ("sốt", 0), ("chưa  ăn", 6)])
def test_leading_negation(spark, t, n):
    assert spark.range(1).select(context.leading_negation(F.lit(t)).alias("x")).first()["x"] == n


def kb(spark, *pairs):
    return spark.createDataFrame([(0, i, c, t) for i, (c, t) in enumerate(pairs)], "prio int, ord bigint, code string, term string")


def linked(df):
    return {r["text"]: (r["codes"], r["step"]) for r in df.collect()}


def test_link_cascade(spark):
    drugs = kb(spark, ("1", "losartan"), ("2", "albuterol 2.5 mg oral tablet"), ("3", "pyridoxine"), ("4", "albuterol"), ("1", "losartan potassium"))
    m = spark.createDataFrame([("Losartan",), ("losartan 50 mg po",), ("salbutamol 2,5mg",), ("vitamin b6",), ("losartam potassium",), ("",), ("zzz",), (None,)], "text string")
    got = linked(link.link_terms(m, drugs, "drug"))
    assert got["Losartan"] == (["1"], "exact") and got["losartan 50 mg po"] == (["1"], "ingredient")
    assert got["salbutamol 2,5mg"] == (["2"], "product") and got["vitamin b6"] == (["3"], "ingredient")
    assert got["losartam potassium"] == (["1"], "fuzzy") and got[""] == ([], None) and got["zzz"] == ([], None) and got[None] == ([], None)
    dx = kb(spark, ("I10", "tăng huyết áp"), ("J18", "viêm phổi"), ("I11", "tăng huyết áp"))
    m = spark.createDataFrame([("THA",), ("tang huyet ap",), ("viêm phổi, trái",)], "text string")
    assert linked(link.link_terms(m, dx, top_k=2)) == {"THA": (["I10", "I11"], "abbreviation"), "tang huyet ap": (["I10", "I11"], "exact"), "viêm phổi, trái": ([], None)}
    assert linked(link.link_terms(m, dx, aggressive=True))["viêm phổi, trái"] == (["J18"], "part")


def test_code_order_is_that_of_the_codes(spark):
    k = kb(spark, ("B", "x"), ("A", "y"), ("A", "x"), ("B", "y"))
    got = {r["norm"]: r["codes"] for r in link.exact_index(k).collect()}
    assert got == {"x": ["B", "A"], "y": ["B", "A"]}


def test_fuzzy_filter_loses_nothing(spark):
    terms = ["".join(p) + " " + "".join(q) for p in itertools.product("ab", repeat=4) for q in itertools.product("ac", repeat=3)] + ["a", "ab", "abc de", "benh tim man tinh"]
    asked = ["aabb aac", "abab ccaa", "bbbba acc", "ab", "abd", "man tinh benh tim", "benh tim man tin"]
    k = kb(spark, *[(str(i), t) for i, t in enumerate(terms)])
    for threshold in (90, 82):
        got = {r["key"]: (r["code"], round(r["score"], 9)) for r in link.fuzzy_best(spark.createDataFrame([(a,) for a in asked], "key string"), link.choices(k), threshold).collect()}
        want = {}
        for a in asked:
            best = max(((ratio(" ".join(sorted(a.split())), " ".join(sorted(t.split()))), -i) for i, t in enumerate(terms)))
            if best[0] >= threshold:
                want[a] = (str(-best[1]), round(best[0], 9))
        assert got == want


def test_dictionary_labels_against_a_loop(spark):
    none = spark.createDataFrame([], "ord bigint, term string")
    symptoms = spark.createDataFrame([(0, "suy tim"), (1, "suy tim cấp"), (2, "ho khan"), (3, "khan họng đỏ")], "ord bigint, term string")
    index = weak.term_index(kb(spark, ("D1", "tăng huyết áp")), kb(spark, ("R1", "aspirin"), ("R2", "aspirin 81 mg")), symptoms, none)
    terms = {r["norm"]: (r["type"], r["code"]) for r in index.collect()}
    assert terms["tha"] == ("CHẨN_ĐOÁN", "D1") and "aspirin 81 mg" not in terms
    texts = ["bn suy tim cấp. (ho khan họng đỏ) aspirin,THA", "  suy  tim\nTHA suy", "", "ho khan khan họng đỏ tha"]

    def loop(raw):
        import re

        toks, out, i = [(m.start(), m.end()) for m in re.finditer(r"\S+", raw)], [], 0
        while i < len(toks):
            for j in range(min(len(toks), i + 8), i, -1):
                s, e = toks[i][0], toks[j - 1][1]
                while e > s and raw[e - 1] in " \t,.;:)]}\"'”’":
                    e -= 1
                while s < e and raw[s] in " \t([{\"'“‘":
                    s += 1
                if e > s and " ".join(normalize_literal(raw[s:e]).split()) in terms:
                    out.append((s, raw[s:e]))
                    while i < len(toks) and toks[i][0] < e:
                        i += 1
                    break
            else:
                i += 1
        return out

    got = weak.distant_label(notes(spark, *texts), index)
    for n, raw in enumerate(texts):
        assert rows(got.where(F.col("doc_id") == n), "start", "text") == loop(raw)


def test_vote_and_overlaps(spark):
    raw = "sốt cao và ho khan, sốt cao"
    marks = ['<c type="TRIỆU_CHỨNG" a="isNegated">sốt cao</c> x <c type="TRIỆU_CHỨNG">sốt cao</c>', '<c type="TRIỆU_CHỨNG">sốt cao</c><c type="TRIỆU_CHỨNG">ho</c>', '<c type="TRIỆU_CHỨNG" a="isNegated">sốt cao</c><c type="TRIỆU_CHỨNG">ho khan</c><c type="TRIỆU_CHỨNG">ho khan</c><c type="THUỐC">bịa</c>']
    s = spark.createDataFrame([(7, i, raw, m) for i, m in enumerate(marks)], "doc_id bigint, sample int, raw string, marked string")
    assert rows(weak.ground(s).where("sample = 0"), "start", "end") == [(0, 7), (20, 27)]
    got = rows(weak.vote(s, 2), "start", "text", "assertions", "votes")
    assert got == [(0, "sốt cao", ["isNegated"], 3)]
    assert rows(weak.vote(s, 1), "start", "text") == [(0, "sốt cao"), (11, "ho khan"), (20, "sốt cao")]


def test_windows_and_token_chunks_against_loops(spark):
    raw = "".join(f"dòng {i} {'x' * (i * 7 % 23)}\n" for i in range(30)) + "y" * 90
    got = rows(weak.windows(notes(spark, raw), 60), "w0", "w1")
    want, at, spans = [], 0, []
    for line in raw.splitlines(keepends=True):
        spans.append((at, at + len(line)))
        at += len(line)
    for s, e in spans:
        if want and e - want[-1][0] <= 60:
            want[-1] = (want[-1][0], e)
        else:
            want.append((s, e))
    assert got == want
    chunks = sequence.chunk_lines(notes(spark, raw), 14).collect()
    assert "".join(raw[c["start"] : c["end"]] for c in sorted(chunks, key=lambda c: c["chunk"])) == raw
    assert all(len(raw[c["start"] : c["end"]].split()) <= 12 for c in chunks)


def test_cleaning(spark):
    raw = "(a) viêm phổi (trái), u; 12 ; sốt."
    d = notes(spark, raw)
    spans = [(4, 20, "CHẨN_ĐOÁN"), (4, 13, "CHẨN_ĐOÁN"), (22, 23, "TRIỆU_CHỨNG"), (25, 27, "TRIỆU_CHỨNG"), (30, 34, "TRIỆU_CHỨNG")]
    c = spark.createDataFrame([(0, i, raw[s:e], t, s, e, [], []) for i, (s, e, t) in enumerate(spans)], "doc_id bigint, ord int, text string, type string, start int, end int, assertions array<string>, candidates array<string>")
    assert rows(weak.clean_concepts(c, d), "start", "text") == [(4, "viêm phổi"), (30, "sốt")]
    k = kb(spark, ("J", "viêm"))
    assert rows(weak.clean_concepts(c, d, k, k), "start", "text") == [(4, "viêm"), (30, "sốt")]


def test_bio(spark):
    ids = {n: i for i, n in enumerate(sequence.LABELS)}
    a, b = "TRIỆU_CHỨNG", "THUỐC"
    toks = [(ids[f"B-{a}"], 0, 2, 0.8), (ids[f"I-{a}"], 3, 5, 0.6), (0, 5, 5, 0.1), (ids[f"I-{b}"], 6, 8, 0.9), (0, 9, 10, 0.5), (ids[f"B-{b}"], 11, 12, 0.7)]
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(toks)], "doc_id bigint, i int, label_id int, a int, b int, conf double")
    assert [(s, e, k, round(c, 6)) for s, e, k, c in rows(sequence.bio_decode(t), "start", "end", "type", "conf")] == [(0, 5, a, 0.7), (6, 8, b, 0.9), (11, 12, b, 0.7)]
    c = spark.createDataFrame([(1, 0, a, 0, 5), (1, 1, b, 6, 8)], "doc_id bigint, ord int, type string, start int, end int")
    assert [x for _, x in rows(sequence.bio_encode(t.drop("label_id", "conf"), c), "i", "label_id")] == [ids[f"B-{a}"], ids[f"I-{a}"], -100, ids[f"B-{b}"], 0, 0]


def test_fixed_blocks(spark):
    t = spark.createDataFrame([(d, i, f"{d}.{i}") for d in (1, 5000, 9) for i in range(3)], "doc_id bigint, i int, token string")
    assert rows(sequence.fixed_blocks(t, 4), "block", "tokens") == [(0, ["1.0", "1.1", "1.2", "9.0"]), (1, ["9.1", "9.2", "5000.0", "5000.1"])]
    assert len(sequence.fixed_blocks(t, 100).first()["tokens"]) == 9
    assert sequence.fixed_blocks(t.limit(0), 4).count() == 0


def pair(spark, pred, gold):
    return spark.createDataFrame([(0, pred, gold)], f"doc_id bigint, pred {score.CONCEPTS}, gold {score.CONCEPTS}")


def test_scores(spark):
    c = lambda t, k, s, e, a=(), x=(): (t, k, s, e, list(a), list(x))
    gold = [c("aspirin 81", "THUỐC", 0, 10, ["isNegated"], ["1"]), c("sốt", "TRIỆU_CHỨNG", 20, 23)]
    same = score.score_dataset(pair(spark, gold, gold)).first()
    assert (same["final"], same["n"]) == (1.0, 1)
    s = score.score_samples(pair(spark, [c("aspirin", "THUỐC", 0, 7, [], ["1", "2"]), c("sốt", "CHẨN_ĐOÁN", 20, 23)], gold)).first()
    assert abs(s["wer"] - (0.5 + 1 + 1) / 3) < 1e-9 and s["assertions"] == 0.0 and abs(s["candidates"] - 0.25) < 1e-9 and s["weight"] == 3.0
    two = spark.createDataFrame([(0, None, [c("a", "THUỐC", 0, 1, [], ["1"])]), (1, [c("b", "THUỐC", 0, 1, [], list("12345"))], [c("b", "THUỐC", 0, 1, [], list("12345"))])], f"doc_id bigint, pred {score.CONCEPTS}, gold {score.CONCEPTS}")
    assert abs(score.score_dataset(two).first()["candidates_score"] - 0.75) < 1e-9
    assert score.score_dataset(two.limit(0)).first()["final"] == 0.0
    near = score.score_samples(pair(spark, [c("a", "THUỐC", 5, 9), c("a", "THUỐC", 0, 9)], [c("a", "THUỐC", 0, 9)]), score.ScorerConfig(penalize_orphans=False)).first()
    assert near["candidates"] == 1.0 and near["wer"] == 0.5
    assert score.score_samples(pair(spark, [c("A  b", "THUỐC", 50, 54)], [c("a b", "THUỐC", 0, 3)]), score.ScorerConfig(align_mode="exact_text", wer_mode="concat", wer_lowercase=True)).first()["wer"] == 0.0
    with pytest.raises(ValueError):
        score.ScorerConfig(align_mode="x")


def test_synthetic_notes_are_grounded_and_score_themselves(spark):
    made = synth.generate(spark, 20)
    flat = made.select("text", F.explode("concepts").alias("c"))
    assert flat.where(~is_grounded(F.col("text"), F.col("c.text"), F.col("c.start"), F.col("c.end"))).count() == 0
    assert rows(made, "doc_id", "text") == rows(synth.generate(spark, 20), "doc_id", "text")
    got = jobs.evaluate(made, lambda d: extract.extract(d)).first()
    assert got["n"] == 20 and got["text_score"] > 0.6


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("10.txt", NOTE), ("2.txt", "a\r\nb")):
        (tmp_path / "in" / name).write_bytes(body.encode())
    d = readers.read_documents(spark, str(tmp_path / "in"))
    assert [r["doc_id"] for r in d.orderBy(*readers.file_order(F.col("path"))).collect()] == ["2", "10"]
    assert d.where("doc_id = '2'").first()["raw"] == "a\r\nb"
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "none"))
    rec = writers.to_records(extract.extract(d), d)
    assert writers.write_json_files(rec, str(tmp_path / "json")) == 2
    one = (tmp_path / "json" / "10.json").read_text(encoding="utf-8")
    assert one.startswith('[\n  {\n    "text": ') and [x["text"] for x in json.loads(one)] == [r["text"] for r in rec.where("doc_id = '10'").first()["records"]]
    (tmp_path / "many").mkdir()
    for name, n in (("b.csv", 3), ("a.csv", 2000)):
        (tmp_path / "many" / name).write_text("code,term\n" + "".join(f"{name}{i},t{i}\n" for i in range(n)), encoding="utf-8")
    kept = [r["code"] for r in readers.read_kb_csv(spark, str(tmp_path / "many")).orderBy("ord").collect()]
    assert kept == [f"a.csv{i}" for i in range(2000)] + [f"b.csv{i}" for i in range(3)]
    for name in ("rxnorm_seed", "icd10_seed"):
        assert readers.starter_kb(spark, name).where("code <> '' and term <> ''").count() >= 30
    assert writers.write_zip(rec, str(tmp_path / "o.zip")) == 2
    lab = d.select("doc_id", F.col("raw").alias("text")).join(score.nest(extract.extract(d), "concepts"), "doc_id", "left")
    writers.write_labelled(lab.na.fill("").withColumn("concepts", F.coalesce("concepts", F.array().cast(score.CONCEPTS))), str(tmp_path / "l"))
    back = readers.read_labelled(spark, str(tmp_path / "l"))
    assert back.count() == 2 and back.where("doc_id = '10'").first()["concepts"][0]["start"] >= 0
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "rxnorm_seed.csv").write_text("code,term\n1,aspirin\n,x\n2, losartan \n", encoding="utf-8")
    assert rows(readers.read_drug_kb(spark, str(tmp_path / "kb")), "code", "term") == [("1", "aspirin"), ("2", "losartan")]
    fields = ["7", "ENG"] + [""] * 10 + ["IN", "", "aspirin", ""]
    (tmp_path / "kb" / "RXNCONSO.RRF").write_text("|".join(fields) + "\nshort|ENG\n", encoding="utf-8")
    assert rows(readers.read_drug_kb(spark, str(tmp_path / "kb")), "code", "term") == [("7", "aspirin")]
    assert spark.range(1).select(readers.parse_api(F.lit('{"idGroup":{"rxnormId":["9"]}}')).alias("x")).first()["x"] == "9"


def test_predict_job(spark):
    d = notes(spark, NOTE)
    k = kb(spark, ("R", "aspirin"))
    got = jobs.predict(d, k, k, clean=True)
    assert got.where("text = 'aspirin 81 mg po'").first()["candidates"] == ["R"]
    assert jobs.predict_records(d, drug_kb=k, disease_kb=k).count() == 1
    info = jobs.diagnostics(d, got)
    assert info["violations"].count() == 0 and info["totals"].first()["docs"] == 1
    spans = spark.createDataFrame([(0, "gout", "CHẨN_ĐOÁN", NOTE.index("gout"), NOTE.index("gout") + 4, 0.9), (0, "x", "THUỐC", 0, 1, 0.1)], "doc_id bigint, text string, type string, start int, end int, conf double")
    assert rows(jobs.predict(d, spans=spans, min_prob=0.5), "text", "assertions") == [("gout", ["isHistorical"])]
    assert rows(jobs.sweep(spans, (0.0, 0.6)), "threshold", "spans") == [(0.0, 2), (0.6, 1)]
    assert Settings().fuzzy_threshold == 90
