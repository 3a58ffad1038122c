"""Clinical-looking notes derived from orders, lineitem and part, the same text in Spark and in SQL.

The test tables hold no clinical notes; these give every section, bullet and measurement form the rules look at, one
note per order that has line items, by integer arithmetic only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The three lines that a line item adds; the same text is valid in Spark SQL and DuckDB.
DIAGNOSIS_LINE = """concat('- suy ', lower(p_type), case when l_partkey % 5 = 0 then ': giai đoạn 2' when l_partkey % 5 = 1 then ', không đặc hiệu' else '' end)"""
DRUG_LINE = """concat('- ', p_name, ' ', cast(cast(l_quantity as int) as varchar(20)), ' mg po bid', case when l_partkey % 4 = 0 then ' điều trị đau' when l_partkey % 4 = 1 then ' (sau ăn)' else '' end)"""
LAB_LINE = """case when l_partkey % 4 = 0 then concat('- kali: ', cast(cast(round(l_tax * 100) as int) as varchar(20)), ',', cast(l_partkey % 10 as varchar(20)), ' mmol/L; ghi chú')
 when l_partkey % 4 = 1 then concat('WBC ', cast(l_partkey % 20 + 1 as varchar(20)), ',', cast(100 + l_partkey % 900 as varchar(20)), ' ; ure ', cast(l_partkey % 9 as varchar(20)), '.5->7.4')
 when l_partkey % 4 = 2 then '- siêu âm bình thường' else concat('- Na ', cast(130 + l_partkey % 20 as varchar(20))) end"""
#: Text before, between and after the items' lines, by order key.
HEAD = """concat(case when o_orderkey % 2 = 0 then '1. Tiền sử bệnh' else '1. Bệnh sử hiện tại' end, chr(10), 'Các bệnh mạn tính:', chr(10))"""
DRUG_HEAD = """concat(chr(10), case when o_orderkey % 3 = 0 then '* Thuốc trước khi nhập viện' else 'Thuốc đang dùng:' end, chr(10))"""
SYMPTOM_PART = """concat(chr(10), '2. Đánh giá tại bệnh viện', chr(10), 'Triệu chứng hiện tại: ', case when o_orderkey % 4 = 0 then 'không sốt, ho khan; đau ngực' when o_orderkey % 4 = 1 then 'Không có phù, khó thở' else 'mệt mỏi, sụt cân' end, chr(10), case when o_orderkey % 7 = 0 then concat('- Gia đình có người bị ho', chr(10)) else '' end, case when o_orderkey % 5 = 0 then concat('- phủ nhận đau đầu', chr(10)) else '' end, 'Kết quả xét nghiệm:', chr(10))"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: one shuffle by order key beside the join with part."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    lines = items.select("l_orderkey", F.struct("l_linenumber", F.expr(DIAGNOSIS_LINE).alias("dx"), F.expr(DRUG_LINE).alias("drug"), F.expr(LAB_LINE).alias("lab")).alias("x"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    listed = lambda f: F.array_join(F.transform("x", lambda x: x[f]), "\n")
    keyed = per.withColumnRenamed("l_orderkey", "o_orderkey")
    raw = F.concat(F.expr(HEAD), listed("dx"), F.expr(DRUG_HEAD), listed("drug"), F.expr(SYMPTOM_PART), listed("lab"))
    return keyed.select(F.col("o_orderkey").alias("doc_id"), raw.alias("raw"))


def notes_sql() -> str:
    """The same as DuckDB common table expressions ending in ``notes``."""
    order = "order by l_linenumber, dx, drug, lab"
    return f"""
items as (select l_orderkey as o_orderkey, l_linenumber, {DIAGNOSIS_LINE} as dx, {DRUG_LINE} as drug, {LAB_LINE} as lab from lineitem join part on l_partkey = p_partkey),
grouped as (select o_orderkey, string_agg(dx, chr(10) {order}) as dxs, string_agg(drug, chr(10) {order}) as drugs, string_agg(lab, chr(10) {order}) as labs from items group by o_orderkey),
notes as (select o_orderkey as doc_id, concat({HEAD}, dxs, {DRUG_HEAD}, drugs, {SYMPTOM_PART}, labs) as raw from grouped)"""
