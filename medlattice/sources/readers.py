"""Sources (S1-S10, S14-S19): documents, labelled JSON lines, knowledge-base files and their reshaping."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import DOSING_WORDS, ORAL_WORDS, RRF_TERM_TYPES, WEIGHT_UNITS
from ..functions.text import WS, strip

LABELLED = "doc_id string, text string, concepts array<struct<text:string,type:string,position:array<int>,assertions:array<string>,candidates:array<string>>>"
CONCEPT = "struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>"


def file_order(path: Column) -> list[Column]:
    """Natural order of files: the first number in the name (none: last), then the name."""
    name = F.element_at(F.split(path, "/"), -1)
    return [F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(1 << 30)), name]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem), raw (untouched), path of every ``*.txt``; FileNotFoundError if there is none."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.text(path if path.endswith(".txt") else path.rstrip("/") + "/*.txt", wholetext=True)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """S3: doc_id, text, concepts with start and end; missing fields become empty."""
    rows = spark.read.schema(LABELLED).json(path).where("doc_id is not null or text is not null")
    empty = F.array().cast("array<string>")
    made = lambda c: F.struct(
        F.coalesce(c["text"], F.lit("")).alias("text"), F.coalesce(c["type"], F.lit("")).alias("type"), F.coalesce(F.get(c["position"], 0), F.lit(0)).alias("start"),
        F.coalesce(F.get(c["position"], 1), F.lit(0)).alias("end"), F.coalesce(c["assertions"], empty).alias("assertions"), F.coalesce(c["candidates"], empty).alias("candidates"),
    )
    return rows.select("doc_id", "text", F.transform(F.coalesce("concepts", F.array().cast(rows.schema["concepts"].dataType)), made).alias("concepts"))


# --- knowledge bases: ord, code, term; ``ord`` is the place of the line in its file


def _with_order(rows: DataFrame) -> DataFrame:
    """``ord``: a row's place by file name, then by where in the file it stands, whatever order the splits are scanned in."""
    path, begin = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    splits = sorted(tuple(r) for r in rows.select(path, begin).distinct().collect())  # a row for each split of the files
    if not splits:
        return rows.withColumn("ord", F.monotonically_increasing_id())
    number = F.create_map(*[F.lit(x) for i, (p, b) in enumerate(splits) for x in (f"{p}|{b}", i)])
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rows of a split keep their order in its task
    return rows.withColumn("ord", F.element_at(number, F.concat_ws("|", path, begin.cast("string"))).cast("bigint") * (1 << 33) + within)


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select("ord", strip(F.col("code")).alias("code"), strip(F.col("term")).alias("term")).where("code <> '' and term <> ''")


def read_kb_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the header code,term; all strings."""
    return _clean(_with_order(spark.read.option("header", True).option("escape", '"').csv(path)))


def parse_rrf(lines: DataFrame, term_types: list[str] | None = None, language: str = "ENG") -> DataFrame:
    """S6 over lines (ord, value): pipe-delimited, at least 15 fields; keeps one language and some term types."""
    f = F.split("value", r"\|", -1)
    rows = lines.where(F.size(f) >= 15).where((F.get(f, 1) == language) & F.get(f, 12).isin(term_types or RRF_TERM_TYPES))
    return _clean(rows.select("ord", F.get(f, 0).alias("code"), F.get(f, 14).alias("term")))


def read_rrf(spark: SparkSession, path: str, term_types: list[str] | None = None, language: str = "ENG") -> DataFrame:
    return parse_rrf(_with_order(spark.read.text(path)), term_types, language)


def merge(*sources: DataFrame) -> DataFrame:
    """Sources in order of precedence: prio, ord, code, term."""
    out = None
    for i, s in enumerate(sources):
        rows = s.select(F.lit(i).alias("prio"), "ord", "code", "term")
        out = rows if out is None else out.unionByName(rows)
    return out


def _existing(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f"{folder}/{n}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(root, n))]


def read_drug_kb(spark: SparkSession, folder: str) -> DataFrame:
    """The full list and the RRF file; without terms from these the API cache; without that the seed."""
    found = [read_rrf(spark, p) if p.endswith(".RRF") else read_kb_csv(spark, p) for p in _existing(spark, folder, ["rxnorm_full.csv", "RXNCONSO.RRF"])]
    for name in (None, "rxnorm_api.csv", "rxnorm_seed.csv"):
        if name:
            found = [read_kb_csv(spark, p) for p in _existing(spark, folder, [name])]
        if found and not (kb := merge(*found)).isEmpty():
            return kb
    raise FileNotFoundError(folder)


def read_disease_kb(spark: SparkSession, folder: str) -> DataFrame:
    """S8."""
    found = _existing(spark, folder, ["icd10.csv", "icd10_vi.csv", "icd10_seed.csv"])
    if not found:
        raise FileNotFoundError(folder)
    return merge(*[read_kb_csv(spark, p) for p in found])


def starter_kb(spark: SparkSession, name: str) -> DataFrame:
    """Our own short list of common drugs (``rxnorm_seed``) or diseases (``icd10_seed``) in KB form, so that linking works out of the box."""
    import csv
    from importlib.resources import files

    with files("medlattice").joinpath(f"data/{name}.csv").open(encoding="utf-8") as f:
        rows = [(0, i, r["code"], r["term"]) for i, r in enumerate(csv.DictReader(f))]
    return spark.createDataFrame(rows, "prio int, ord bigint, code string, term string")


def reshape_icd_en(rows: DataFrame) -> DataFrame:
    """S14 over cells (array): rows of at least five; a dot after the code's third character; the long name, else the short."""
    c = F.col("cells")
    code = F.get(c, 2)
    dotted = F.when(F.length(code) > 3, F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 1 << 20))).otherwise(code)
    return rows.where(F.size(c) >= 5).select(dotted.alias("code"), F.coalesce(F.nullif(strip(F.get(c, 4)), F.lit("")), strip(F.get(c, 3))).alias("term")).where("code <> '' and term <> ''")


def reshape_icd_vi(rows: DataFrame, code_pattern: str = r"^[A-Z]\d{2}(?:\.\d+)?[*†+]?$") -> DataFrame:
    """S15 over cells: beside each code the cell two or one after it, if it is a native term; lower case, distinct."""
    c = F.transform(F.col("cells"), strip)
    at = rows.withColumn("_c", c).select("_c", F.posexplode("_c").alias("i", "code")).where(F.col("code").rlike(code_pattern))
    native = lambda t: t.isNotNull() & t.rlike(r"[^\x00-\x7f]") & (F.length(t) > 3) & ~t.rlike(code_pattern)
    two, one = F.get("_c", F.col("i") + 2), F.get("_c", F.col("i") + 1)
    term = F.when(native(two), two).when(native(one), one)
    return at.select(F.regexp_replace("code", r"[*†+]$", "").alias("code"), F.lower(term).alias("term")).where("term is not null").distinct()


def distinct_terms(kb: DataFrame) -> DataFrame:
    """Distinct (code, term); order it when writing."""
    return kb.select("code", "term").distinct()


def missing_mentions(mentions: DataFrame, cache: DataFrame) -> DataFrame:
    """Mentions that no cached term equals."""
    return mentions.select("term").distinct().join(cache.select("term").distinct(), "term", "left_anti")


def drug_mentions(concepts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct texts of extracted drugs and of a lexicon (term)."""
    from ..functions.config import DRUG

    return concepts.where(F.col("type") == DRUG).select(F.col("text").alias("term")).union(lexicon.select("term")).distinct()


def clean_query(c: Column) -> Column:
    """A mention without dosing words, colons, brackets and dots, its case kept; an oral drug with a weight asks for the tablet."""
    word = lambda options: rf"(?iU)\b(?:{'|'.join(options)})\b"
    plain = F.regexp_replace(F.regexp_replace(c, "[:().]", " "), word(DOSING_WORDS), " ")
    name = strip(F.regexp_replace(plain, f"(?U){WS}+", " "))
    weighed = F.lower(c).rlike(rf"(?U)\d{WS}*(?:{'|'.join(WEIGHT_UNITS)})\b")
    return F.when(F.lower(c).rlike(word(ORAL_WORDS)) & weighed, F.concat(name, F.lit(" oral tablet"))).otherwise(name)


def parse_api(payload: Column) -> Column:
    """S13, shape only: the code of an exact or, else, of an approximate answer."""
    exact = F.get_json_object(payload, "$.idGroup.rxnormId[0]")
    return F.coalesce(exact, F.get_json_object(payload, "$.approximateGroup.candidate[0].rxcui"))


def word_rows(docs: DataFrame, text: str) -> DataFrame:
    """Tokens of documents with their numbers."""
    return docs.select("doc_id", F.posexplode(F.filter(F.split(F.col(text), f"(?U){WS}+"), lambda t: t != "")).alias("i", "token"))


