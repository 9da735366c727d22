"""File sources for evaluation data (SRC01-SRC10, SRC12-SRC19, SRC21).

Every reader is a Spark scan with an explicit schema where the format allows it
(never schema inference at scale), followed by built-in nested-data expressions
(``explode``, ``arrays_zip``, ``map_entries``, ``from_json``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.extract import py_strip
from ..functions.text import col
from ..operators.sampling import dense_index
from .zstd_lines import read_zstd_lines, write_zstd_lines


# ----------------------------------------------------------------------- SRC01-SRC04
def read_eval_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC01: JSON lines with a declared schema (blank lines are skipped by the reader)."""
    return spark.read.schema(schema).json(path)


def scan_by_stem(spark: SparkSession, path_glob: str, schema, stem_regex: str = r"([^/]+)\.jsonl?$",
                 name: str = "dataset") -> DataFrame:
    """SRC02: many files, the file stem becomes the dataset name."""
    return (spark.read.schema(schema).json(path_glob)
                 .withColumn(name, F.regexp_extract(F.input_file_name(), stem_regex, 1)))


def load_eval_family(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """SRC03 / SET01: union of named datasets (missing columns become null)."""
    out = None
    for k, df in parts.items():
        d = df.withColumn(name, F.lit(k))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def route_splits(df: DataFrame, field: str, mapping: dict | None = None, name: str = "split") -> DataFrame:
    """SRC04: a row's split comes from one of its fields (optionally renamed)."""
    c = col(field).cast("string")
    if mapping:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        c = F.coalesce(m[c], c)
    return df.withColumn(name, c)


# ----------------------------------------------------------------------- SRC05-SRC08
SQUAD_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(T.StructType([
        T.StructField("context", T.StringType()),
        T.StructField("qas", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("question", T.StringType()),
            T.StructField("answers", T.ArrayType(T.StructType([
                T.StructField("text", T.StringType()), T.StructField("answer_start", T.LongType())])))])))])))])))])


def flatten_squad(df: DataFrame) -> DataFrame:
    """SRC05: article -> paragraph -> question rows with answer texts / starts."""
    a = df.select(F.explode("data").alias("a"))
    p = a.select(F.col("a.title").alias("title"), F.explode("a.paragraphs").alias("p"))
    q = p.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return q.select("title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"),
                    F.transform("q.answers", lambda x: x["text"]).alias("answers"),
                    F.transform("q.answers", lambda x: x["answer_start"]).alias("answer_starts"))


def flatten_map_qa(df: DataFrame, map_col: str = "sections") -> DataFrame:
    """SRC06: map section_id -> {passage, qa_pairs[{question, query_id, answer, validated_answers}]}
    -> one row per question; missing validated answers become an empty array."""
    s = df.select(F.explode(col(map_col)).alias("section_id", "v"))
    q = s.select("section_id", F.col("v.passage").alias("passage"), F.explode("v.qa_pairs").alias("qa"))
    return q.select("section_id", "passage", F.col("qa.query_id").alias("query_id"),
                    F.col("qa.question").alias("question"), F.col("qa.answer").alias("answer"),
                    F.coalesce(F.col("qa.validated_answers"), F.array()).alias("validated_answers"))


def flatten_dialog_qa(df: DataFrame) -> DataFrame:
    """SRC07: one row per turn from parallel question / answer arrays (turn id from 1)."""
    z = df.select("id", "story", F.posexplode(F.arrays_zip(F.col("questions").alias("q"),
                                                         F.col("answers").alias("a"))).alias("i", "qa"))
    return z.select("id", "story", (F.col("i") + 1).alias("turn_id"), F.col("qa.q").alias("question"),
                    F.col("qa.a").alias("answer"))


def flatten_exam_map(df: DataFrame, map_col: str = "exams") -> DataFrame:
    """SRC08: exam-keyed map of question lists -> rows with id '<exam>_<qid>', trimmed
    text and the answer cast to int."""
    e = df.select(F.explode(col(map_col)).alias("exam", "qs"))
    q = e.select("exam", F.explode("qs").alias("q"))
    return q.select(F.concat_ws("_", "exam", F.col("q.qid").cast("string")).alias("id"), "exam",
                    py_strip(F.col("q.qtext")).alias("question"), F.col("q.ra").cast("int").alias("answer"),
                    F.col("q.answers").alias("choices"))


# ----------------------------------------------------------------------- SRC09 / SRC10
def parse_block_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC09: records separated by blank lines: label, context, question, options (the
    two-character option prefix is cut); '.' -> '. ' then strip."""
    norm = lambda c: py_strip(F.replace(c, F.lit("."), F.lit(". ")))
    t = spark.read.option("lineSep", "\n\n").text(path).filter(F.length(py_strip("value")) > 0)
    lines = F.split(F.col("value"), "\n")
    return t.select(py_strip(F.element_at(lines, 1)).alias("label"), norm(F.element_at(lines, 2)).alias("context"),
                    norm(F.element_at(lines, 3)).alias("question"),
                    F.transform(F.slice(lines, 4, 1 << 20), lambda o: norm(F.substring(o, 3, 1 << 30))).alias("options"))


def parse_tail_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: blank-line records, '#' comment lines dropped, the last 8 lines used:
    source, stem, 5 choices, solution (a record with fewer lines gives nulls)."""
    t = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.transform(F.split(F.col("value"), "\n"), lambda x: py_strip(x)),
                     lambda x: (x != "") & ~x.startswith("#"))
    tail = F.slice(lines, -8, 8)
    return (t.select(tail.alias("r")).filter(F.size("r") > 0)
             .select(F.element_at("r", 1).alias("source"), F.element_at("r", 2).alias("stem"),
                     F.slice("r", 3, 5).alias("choices"), F.element_at("r", 8).alias("solution")))


# ----------------------------------------------------------------------- SRC12-SRC19
def read_exam_xml(spark: SparkSession, path: str, row_tag: str = "question", schema=None) -> DataFrame:
    """SRC12: XML rows (built-in XML source); attributes arrive as ``_name`` columns."""
    r = spark.read.format("xml").option("rowTag", row_tag)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def tag_fixed_groups(df: DataFrame, k: int, order: list[Column], keys=(), name: str = "group_id") -> DataFrame:
    """SRC13: consecutive rows (in an explicit order) grouped k at a time."""
    d = dense_index(df, list(keys) or [], order, "_pos")
    return d.withColumn(name, F.floor(F.col("_pos") / k)).drop("_pos")


def parse_ref_lists(df: DataFrame, cols: list[str], sep: str = ";") -> DataFrame:
    """SRC14: drop rows with an empty reference; split answer lists on ';' (trimmed)."""
    out = df
    for c in cols:
        out = out.filter(col(c).isNotNull() & (py_strip(col(c)) != ""))
        out = out.withColumn(c, F.transform(F.split(py_strip(col(c)), sep), lambda x: py_strip(x)))
    return out


def choices_from_map(m, letters: str = "ABCDEFGHIJKLM") -> Column:
    """SRC15 / PRJ04: {choice: score} -> struct(choices, scores, gold index, gold letter);
    map order is kept (``from_json`` preserves it)."""
    e = F.map_entries(col(m))
    keys = F.transform(e, lambda x: x["key"])
    vals = F.transform(e, lambda x: x["value"])
    gold = F.array_position(vals, F.array_max(vals)) - 1
    return F.struct(keys.alias("choices"), vals.alias("scores"), gold.alias("gold"),
                    F.substring(F.lit(letters), (gold + 1).cast("int"), 1).alias("gold_letter"))


def subset_by_meta(df: DataFrame, field: str, value: str) -> DataFrame:
    """SRC16: filter on a nested metadata field (pushed to the scan for Parquet)."""
    return df.filter(col(field) == value)


def scan_json_dir(spark: SparkSession, path: str, schema, glob: str = "*.json") -> DataFrame:
    """SRC17: one JSON document per file; empty files skipped; the file name is kept."""
    t = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    t = t.filter(F.length(py_strip("value")) > 0)
    return t.select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("r")).select("file", "r.*")


def rekey_jsonl(df: DataFrame, renames: dict[str, str], replaces: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """SRC18: rename fields and apply literal string replacements (e.g. 'Q:' -> 'Question:')."""
    out = df
    for old, new in renames.items():
        out = out.withColumnRenamed(old, new)
    for c, pairs in (replaces or {}).items():
        v = col(c)
        for a, b in pairs:
            v = F.replace(v, F.lit(a), F.lit(b))
        out = out.withColumn(c, v)
    return out


def read_corpus(spark: SparkSession, path: str, para_joiner: str = "\n\n") -> DataFrame:
    """SRC19: JSON lines whose text is a string or a list of paragraphs (joined), with an
    optional meta object; a line that is a bare JSON string is a document too.
    Compressed files: gzip / bzip2 read natively, ``.zst`` files and folders named ``*.zst``
    through the zstd_lines source."""
    lines = read_zstd_lines(spark, path) if path.rstrip("/").endswith(".zst") else spark.read.text(path)
    t = lines.filter(F.length(py_strip("value")) > 0)
    obj = F.from_json("value", "struct<text:string, meta:map<string,string>>")
    as_list = F.from_json(F.get_json_object("value", "$.text"), "array<string>")
    bare = F.when(py_strip("value").startswith('"'),
                  F.element_at(F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>"), 1))
    is_obj = py_strip("value").startswith("{")
    text = F.when(is_obj, F.coalesce(F.array_join(as_list, para_joiner), obj["text"])).otherwise(bare)
    return t.select(text.alias("text"), F.when(is_obj, obj["meta"]).alias("meta"))


def write_corpus(docs: DataFrame, path: str, text: str = "text", meta: str | None = None) -> None:
    """Write documents as zstd-compressed JSON lines {"text": ..., "meta": {...}} that
    read_corpus reads back; null texts are not written."""
    fields = [col(text).alias("text"), *([col(meta).alias("meta")] if meta else [])]
    write_zstd_lines(docs.filter(col(text).isNotNull()).select(F.to_json(F.struct(*fields)).alias("value")), path)


# ----------------------------------------------------------------------- SRC21
RULE = "=" * 50


def ingest_failure_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC21: failure-audit files -> (file, model, family, dataset, prompt, raw_output,
    clean_output)."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = F.split(F.col("value"), RULE)
    head = F.element_at(parts, 1)

    def block(i, label):
        return F.regexp_replace(F.regexp_replace(F.element_at(parts, i), f"^\\n{label}:\\n", ""), r"\n$", "")
    return t.select("file",
                    F.regexp_extract(head, r"MODEL: (.*?) \| FAMILY:", 1).alias("model"),
                    F.regexp_extract(head, r"FAMILY: ([^\n]*)", 1).alias("family"),
                    F.regexp_extract(head, r"DATASET: ([^\n]*)", 1).alias("dataset"),
                    block(2, "PROMPT").alias("prompt"), block(3, "RAW OUTPUT").alias("raw_output"),
                    block(4, "CLEAN OUTPUT").alias("clean_output"))
