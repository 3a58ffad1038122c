"""Deterministic synthetic notes with grounded gold.

Every draw is a hash of (seed, note, slot), so the table is the same on any cluster; it does not follow any other
generator's random numbers.  The word lists are our own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import ASSERTABLE, DIAGNOSIS, DRUG, FAMILY, HISTORICAL, LAB_NAME, LAB_RESULT, NEGATED, SYMPTOM, TYPES

DRUGS = ["metformin 500 mg", "amlodipine 5 mg", "aspirin 81 mg", "losartan 50 mg", "atorvastatin 20 mg", "omeprazole 40 mg", "furosemide 20 mg", "prednisone 10 mg", "warfarin 2.5 mg", "insulin glargine"]
DIAGNOSES = ["tăng huyết áp", "đái tháo đường type 2", "suy tim", "hen phế quản", "viêm phổi", "suy thận mạn", "rung nhĩ", "thiếu máu", "viêm gan b", "loét dạ dày"]
SYMPTOMS = ["sốt", "ho khan", "đau ngực", "khó thở", "chóng mặt", "buồn nôn", "đau đầu", "mệt mỏi", "phù chân", "mất ngủ", "đau bụng", "sụt cân"]
LABS = [("kali", "mmol/L"), ("natri", "mmol/L"), ("glucose", "mmol/L"), ("WBC", "G/L"), ("Hb", "g/dL"), ("creatinin", "umol/L"), ("CRP", "mg/L"), ("ure", "mmol/L")]
NARRATIVES = ["Bệnh nhân than phiền {c} trong hai ngày qua.", "Ghi nhận {c} khi thăm khám.", "Người nhà cho biết có {c} vào ban đêm."]


def _draw(seed: int, *slot) -> Column:
    """A number in [0, 2**30) for a note and a slot."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("i"), *[s if isinstance(s, Column) else F.lit(s) for s in slot]), F.lit(1 << 30))


def _chance(seed: int, p: float, *slot) -> Column:
    return _draw(seed, *slot) < int(p * (1 << 30))


def _sample(seed: int, values: list, slot: str, low: int, high: int) -> Column:
    """Between ``low`` and ``high`` different values, in hash order."""
    ranked = F.transform(F.array(*[F.lit(j) for j in range(len(values))]), lambda j: F.struct(_draw(seed, slot, j).alias("h"), j.alias("j")))
    return F.transform(F.slice(F.array_sort(ranked), F.lit(1), (_draw(seed, slot, "n") % (high - low + 1) + low).cast("int")), lambda x: x["j"])


PIECE = "struct<text:string,type:string,assertions:array<string>>"


def _piece(text: Column | str, kind: str | None = None, marks: Column | None = None) -> Column:
    t = F.lit(text) if isinstance(text, str) else text
    return F.struct(t.alias("text"), F.lit(kind).cast("string").alias("type"), (marks if marks is not None else F.array().cast("array<string>")).alias("assertions"))


def build(pieces: Column) -> Column:
    """struct(raw, concepts) of appended pieces; typed pieces become spans at the running length."""
    begin = F.struct(F.lit("").alias("raw"), F.array().cast("array<struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>>").alias("concepts"))

    def step(acc, p):
        s = F.length(acc["raw"])
        made = F.struct(p["text"], p["type"], s.alias("start"), (s + F.length(p["text"])).alias("end"), p["assertions"], F.array().cast("array<string>").alias("candidates"))
        return F.struct(F.concat(acc["raw"], p["text"]).alias("raw"), F.when(p["type"].isNotNull(), F.concat(acc["concepts"], F.array(made))).otherwise(acc["concepts"]).alias("concepts"))

    return F.aggregate(pieces, begin, step)


def format_value(h: Column, comma: Column) -> Column:
    """One or two decimals, now and then with a comma."""
    v = F.when(h % 2 == 0, F.format_string("%d.%d", (F.floor(h / 7) % 140 + 1), F.floor(h / 1000) % 10)).otherwise(F.format_string("%d.%02d", (F.floor(h / 7) % 140 + 1), F.floor(h / 1000) % 100))
    return F.when(comma, F.replace(v, F.lit("."), F.lit(","))).otherwise(v)


def generate(spark: SparkSession, n: int, seed: int = 42, p_negated: float = 0.15, p_family: float = 0.15, p_narrative: float = 0.5, p_comma: float = 0.15, p_spaces: float = 0.15) -> DataFrame:
    """doc_id ``synth_i``, text, concepts; every concept is grounded by construction."""
    pick = lambda values, j: F.element_at(F.array(*[F.lit(v) for v in values]), j + 1)
    lines: list[Column] = []

    def listed(values, slot, low, high, kind, marks) -> Column:
        chosen = _sample(seed, values, slot, low, high)
        return F.flatten(F.transform(chosen, lambda j: F.array(_piece("- "), _piece(F.when(_chance(seed, p_negated, slot, "neg", j) & F.lit(kind == SYMPTOM), F.lit("không ")).otherwise("")), _piece(pick(values, j), kind, marks(j)), _piece(F.when(_chance(seed, p_spaces, slot, "sp", j), F.lit("  \n")).otherwise("\n")))))

    family = _chance(seed, p_family, "family")
    lines.append(F.array(_piece("1. Tiền sử bệnh\nCác bệnh lý mạn tính:\n")))
    lines.append(listed(DIAGNOSES, "dx", 1, 3, DIAGNOSIS, lambda j: F.array(F.lit(HISTORICAL))))
    lines.append(F.array(_piece("Thuốc đang dùng:\n")))
    lines.append(listed(DRUGS, "drug", 1, 4, DRUG, lambda j: F.array(F.lit(HISTORICAL))))
    lines.append(F.array(_piece("2. Bệnh sử hiện tại\nTriệu chứng hiện tại:\n")))
    lines.append(listed(SYMPTOMS, "sy", 2, 6, SYMPTOM, lambda j: F.when(_chance(seed, p_negated, "sy", "neg", j), F.array(F.lit(NEGATED))).otherwise(F.array().cast("array<string>"))))
    told = F.when(family, F.array(_piece("Gia đình có người bị "), _piece(pick(DIAGNOSES, (_draw(seed, "famdx") % len(DIAGNOSES)).cast("int")), DIAGNOSIS, F.array(F.lit(FAMILY))), _piece("\n"))).otherwise(F.array().cast(f"array<{PIECE}>"))
    lines.append(told)
    story = lambda k: F.split(pick(NARRATIVES, (_draw(seed, "story", k) % len(NARRATIVES)).cast("int")), r"\{c\}", -1)
    for k in range(3):  # Y4: a template's two halves round a symptom
        some = _chance(seed, p_narrative, "narrative") & (_draw(seed, "stories") % 3 >= k)
        halves = F.array(_piece(F.get(story(k), 0)), _piece(pick(SYMPTOMS, (_draw(seed, "storysy", k) % len(SYMPTOMS)).cast("int")), SYMPTOM), _piece(F.concat(F.get(story(k), 1), F.lit("\n"))))
        lines.append(F.when(some, halves).otherwise(F.array().cast(f"array<{PIECE}>")))
    lines.append(F.array(_piece("3. Đánh giá tại bệnh viện\nKết quả xét nghiệm:\n")))
    chosen = _sample(seed, LABS, "lab", 2, 5)
    value = lambda j: F.concat(format_value(_draw(seed, "value", j), _chance(seed, p_comma, "comma", j)), F.lit(" "), pick([u for _, u in LABS], j))
    lines.append(F.flatten(F.transform(chosen, lambda j: F.array(_piece("- "), _piece(pick([x for x, _ in LABS], j), LAB_NAME), _piece(" "), _piece(value(j), LAB_RESULT), _piece("\n")))))
    made = spark.range(n).withColumnRenamed("id", "i").withColumn("note", build(F.concat(*[x.cast(f"array<{PIECE}>") for x in lines])))
    return made.select(F.concat(F.lit("synth_"), F.col("i").cast("string")).alias("doc_id"), F.col("note.raw").alias("text"), F.col("note.concepts").alias("concepts"))


def train_dev(spark: SparkSession, n_train: int, n_dev: int) -> tuple[DataFrame, DataFrame]:
    """The two sets with their own seeds."""
    return generate(spark, n_train, 42), generate(spark, n_dev, 1234)


SPECIALTIES = ["tim mạch", "hô hấp", "tiêu hóa", "thận", "nội tiết", "thần kinh", "cơ xương khớp", "truyền nhiễm", "huyết học", "da liễu", "ung bướu", "cấp cứu"]


#: What both prompts ask of the mark-up, in our own words.
MARKUP_RULES = "\n".join([
    'Đánh dấu mỗi khái niệm bằng <c type="LOẠI" a="NHÃN">...</c>.',
    f"LOẠI là một trong: {', '.join(TYPES)}.",
    f"NHÃN chỉ dùng cho {', '.join(ASSERTABLE)}: {NEGATED} nếu bị phủ định, {HISTORICAL} nếu thuộc tiền sử, {FAMILY} nếu nói về người thân; nhiều nhãn cách nhau bằng dấu phẩy, không có nhãn thì bỏ a.",
    "Thẻ không lồng nhau, không ôm dấu câu ở hai đầu, và tên xét nghiệm tách khỏi kết quả của nó.",
])
GENERATION_RULES = "\n".join([
    "Bệnh án có các mục đánh số: tiền sử bệnh, bệnh sử hiện tại, đánh giá tại bệnh viện; mỗi mục có gạch đầu dòng hoặc câu kể.",
    "Có ít nhất bốn khái niệm, trong đó có thuốc kèm hàm lượng, xét nghiệm kèm kết quả và một triệu chứng bị phủ định.",
    "Không bịa tên người, địa chỉ hay số giấy tờ. Chỉ trả về bệnh án đã đánh dấu.",
])
ANNOTATION_RULES = "\n".join([
    "Chép lại nguyên văn bệnh án dưới đây, chỉ thêm thẻ: không sửa, thêm hay bớt một ký tự nào, kể cả lỗi chính tả và dấu cách.",
    "Phần trong thẻ phải có nguyên trong bệnh án. Chỉ trả về bệnh án đã đánh dấu.",
])


def generation_prompt(i: Column) -> Column:
    """Asks for a marked note; specialties take turns."""
    topic = F.element_at(F.array(*[F.lit(s) for s in SPECIALTIES]), (F.pmod(i, F.lit(len(SPECIALTIES))) + 1).cast("int"))
    return F.concat(F.lit("Viết một bệnh án ngắn chuyên khoa "), topic, F.lit(f".\n{GENERATION_RULES}\n{MARKUP_RULES}"))


def annotation_prompt(raw: Column, limit: int = 5000) -> Column:
    """Asks for the same note with mark-up; a note's first ``limit`` characters, which is this prompt's contract."""
    return F.concat(F.lit(f"{ANNOTATION_RULES}\n{MARKUP_RULES}\n\n"), F.substring(raw, 1, limit))
