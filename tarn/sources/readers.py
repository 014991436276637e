"""Readers: guideline folders, question sets, lexicons, glossaries, saved indexes, PDFs and settings.

All paths go through Spark's readers, so any store that Spark reads will do. Schemas are explicit.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.tagging import section_tags

SYMPTOM_TAGS = ("chest pain", "retrosternal", "dyspnea", "shortness of breath", "weakness", "hemiparesis")
GUIDELINE = "guideline_id string, title string, content string, category string, keywords array<string>, source string, section_tags array<string>, symptom_tags array<string>"
QUESTION = "question_id string, case_description string, question string, options map<string,string>, correct_answer string, category string, difficulty string, relevance_level string, question_type string, guideline_id string, source_guideline string, explanation string"


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return df.select(F.col("value").alias("content"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """number, name, category of a summary file."""
    rows = spark.read.schema("total_guidelines int, guidelines array<struct<id:int,name:string,category:string,has_source_content:boolean,content_length:int>>").option("multiLine", True).json(path)
    return rows.select(F.explode("guidelines").alias("g")).select(F.col("g.id").alias("number"), F.col("g.name").alias("name"), F.col("g.category").alias("category"))


def guidelines(spark: SparkSession, folder: str, summary_path: str | None = None) -> DataFrame:
    """One row per guideline_*.txt and glossary_*.txt, with the columns of GUIDELINE.

    The title is the first line without marks; category and keywords stand in lines two to six; a missing
    category comes from the summary file, else it is General. A guideline's number is that of its file name.
    """
    g = _files(spark, folder, "guideline_*.txt")
    lines = F.split("content", "\n")
    head = lambda name: F.trim(F.regexp_extract(F.try_element_at(F.filter(F.slice(lines, 2, 5), lambda x: F.lower(x).startswith(name + ":")), F.lit(-1)), r"(?s)^[^:]*:(.*)$", 1))
    number = F.nullif(F.regexp_extract("file", r"guideline_(\d+)_", 1), F.lit("")).cast("int")
    g = g.withColumns({
        "number": F.coalesce(number, F.row_number().over(W.partitionBy(F.lit(0)).orderBy("file"))),  # a folder of files
        "title": F.trim(F.regexp_replace(F.element_at(lines, 1), r"^[# ]+", "")), "category": F.nullif(head("category"), F.lit("")),
        "keywords": F.filter(F.transform(F.split(F.coalesce(head("keywords"), F.lit("")), ","), lambda x: F.trim(x)), lambda k: k != ""),
    })
    known = summary(spark, summary_path).select("number", F.col("category").alias("known")) if summary_path else spark.createDataFrame([], "number int, known string")
    low = F.lower("content")
    g = g.join(known, "number", "left").select(
        F.format_string("GL_%03d", "number").alias("guideline_id"), "title", "content", F.coalesce("category", "known", F.lit("General")).alias("category"), "keywords", F.lit("GuidelineText").alias("source"),
        section_tags(F.col("content")).alias("section_tags"), F.array_compact(F.array(*(F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in SYMPTOM_TAGS))).alias("symptom_tags"),
    )
    stem = F.regexp_replace("file", r"\.txt$", "")
    tags = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    words = _files(spark, folder, "glossary_*.txt").select(
        F.concat(F.lit("GLOSS_"), stem).alias("guideline_id"), F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"), "content", F.lit("Glossary").alias("category"), tags("glossary", "definitions").alias("keywords"),
        F.lit("Glossary").alias("source"), tags("glossary").alias("section_tags"), tags().alias("symptom_tags"),
    )
    return g.unionByName(words)


def guidelines_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GUIDELINE).option("multiLine", True).json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file {metadata, questions: [...]}; options may be a map or a list (then A, B, C, ...)."""
    item = QUESTION.replace("options map<string,string>", "options string")
    inner = ",".join(x.strip().replace(" ", ":", 1) for x in item.split(","))
    q = spark.read.schema(f"questions array<struct<{inner}>>").option("multiLine", True).json(path).select(F.inline("questions"))
    listed = F.from_json("options", "array<string>")
    letters = F.array(*(F.lit(chr(65 + i)) for i in range(26)))
    return q.withColumn("options", F.when(F.col("options").startswith("["), F.map_from_arrays(F.slice(letters, F.lit(1), F.size(listed)), listed)).otherwise(F.from_json("options", "map<string,string>")))


def split_case(questions: DataFrame, least: int = 100) -> DataFrame:
    """A question without a case is cut after the last full sentence before its last question mark, if what comes
    before is long enough; a text that ends in a question mark right away asks for the best answer."""
    q = F.col("question")
    before = F.regexp_extract(q, r"(?s)^(.*)\?(.*)$", 1)
    after = F.trim(F.regexp_extract(q, r"(?s)^(.*)\?(.*)$", 2))
    cut = (F.coalesce(F.length("case_description"), F.lit(0)) == 0) & (F.length(before) > least)
    return questions.withColumns({"case_description": F.when(cut, F.trim(before)).otherwise(F.col("case_description")), "question": F.when(cut, F.when(after == "", "What is the best answer?").otherwise(after)).otherwise(q)})


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """term, pos, synonym (lower case) of a JSON object of lists; entries that are no lists are left out."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "list"))
    return pairs.where(F.col("list").startswith("[")).select(F.lower("term").alias("term"), F.posexplode(F.from_json("list", "array<string>")).alias("pos", "synonym")).withColumn("synonym", F.lower("synonym"))


def expansions(spark: SparkSession, path: str) -> DataFrame:
    """term, synonyms of {terms: [{canonical, aliases, categories}]}, under the name with spaces and with underscores."""
    t = spark.read.schema("terms array<struct<canonical:string,aliases:array<string>,categories:array<string>>>").option("multiLine", True).json(path).select(F.inline("terms"))
    names = F.array_distinct(F.array(F.lower("canonical"), F.replace(F.lower("canonical"), F.lit(" "), F.lit("_"))))
    both = t.withColumn("term", F.explode(names)).select("term", F.explode("aliases").alias("alias"))
    return both.groupBy("term").agg(F.sort_array(F.collect_set(F.lower("alias"))).alias("synonyms"))


def glossary(spark: SparkSession, folder: str) -> DataFrame:
    """term, definition of the lines `TERM: definition` of glossary_*.txt."""
    lines = spark.read.option("pathGlobFilter", "glossary_*.txt").text(folder)
    pair = F.split("value", ":", 2)
    return lines.where(F.contains("value", F.lit(":")) & ~F.col("value").startswith("#")).select(F.trim(pair[0]).alias("term"), F.trim(pair[1]).alias("definition"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their vectors, as saved by sinks.save_index."""
    return spark.read.parquet(path)


def pdf_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, page, text of PDF files; needs pypdf on the executors."""

    def run(frames):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for frame in frames:
            rows = [(p, i + 1, page.extract_text() or "") for p, c in zip(frame["path"], frame["content"], strict=True) for i, page in enumerate(PdfReader(io.BytesIO(c)).pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content").mapInPandas(run, "path string, page int, text string")


@dataclass
class Retrieval:
    stage1_k: int = 150
    stage2_k: int = 100
    stage3_k: int = 25
    weights: tuple[float, float, float] = (0.7, 0.3, 0.4)
    k1: float = 1.5
    b: float = 0.75


@dataclass
class Settings:
    """Settings by section; get() takes dotted names and a default."""

    retrieval: Retrieval = field(default_factory=Retrieval)
    chunk_size: int = 450
    chunk_overlap: int = 120
    temperature: float = 1.5
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Settings:
        own = {f.name for f in fields(cls)}
        r = Retrieval(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.get("retrieval", {}).items() if k in {f.name for f in fields(Retrieval)}})
        return cls(retrieval=r, **{k: v for k, v in values.items() if k in own - {"retrieval", "extra"}}, extra={k: v for k, v in values.items() if k not in own})

    def get(self, name: str, default=None):
        at = self
        for part in name.split("."):
            at = getattr(at, part, None) if is_dataclass(at) else at.get(part) if isinstance(at, dict) else None
            if at is None:
                at = self.extra.get(part) if name.split(".")[0] == part else None
            if at is None:
                return default
        return at
