"""Differential diagnoses from symptoms and context, reasoning steps and the rationale, as rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Diagnoses that a symptom suggests.
SUGGESTED = {
    "chest pain": ("myocardial infarction", "angina", "pulmonary embolism"),
    "shortness of breath": ("heart failure", "pneumonia", "copd", "pulmonary embolism"),
    "fever": ("infection", "sepsis", "pneumonia"),
    "abdominal pain": ("appendicitis", "cholecystitis", "peptic ulcer"),
    "headache": ("migraine", "meningitis", "subarachnoid hemorrhage"),
}
#: The steps of the reasoning template.
STEPS = ("Summary of key symptoms & findings", "Differential diagnosis (>=3)", "Probable diagnosis + rationale (guideline-first)", "Recommended next steps / investigations")


def differentials(found: DataFrame, context: DataFrame, most: int = 5, least: float = 0.2) -> DataFrame:
    """qid, place, diagnosis, symptom, support: diagnoses of the symptoms (qid, symptom), supported by the share of
    three documents (qid, content) that name them; one diagnosis may come from two symptoms, as in the original."""
    spark = found.sparkSession
    table = spark.createDataFrame([(s, i, d) for s, ds in SUGGESTED.items() for i, d in enumerate(ds)], "symptom string, i int, diagnosis string")
    rows = found.select("qid", F.lower("symptom").alias("symptom")).join(table, "symptom")
    named = rows.select("qid", "diagnosis").distinct().join(context.select("qid", "content"), "qid").where(F.contains(F.lower("content"), F.col("diagnosis")))
    support = named.groupBy("qid", "diagnosis").agg(F.least(F.lit(1.0), F.count("*") / F.lit(3.0)).alias("support"))
    order = W.partitionBy("qid").orderBy(F.col("support").desc(), "symptom", "i")
    out = rows.join(support, ["qid", "diagnosis"]).where(F.col("support") > least).withColumn("place", F.row_number().over(order))
    return out.where(F.col("place") <= most).select("qid", "place", "diagnosis", "symptom", "support")


def steps(symptoms: Column, diagnoses: Column, answer: Column, evidence: Column) -> Column:
    """The four steps of the template: array of struct(step, description, reasoning)."""
    none = lambda c, text: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(text)).otherwise(c)
    texts = (
        none(F.array_join(symptoms, ", "), "No symptom named"), none(F.array_join(diagnoses, ", "), "None supported by the context"),
        F.concat(answer, F.lit(": "), none(F.array_join(evidence, "; "), "no direct evidence")), F.concat(F.lit("Confirm "), answer, F.lit(" against the guideline")),
    )
    return F.array(*(F.struct(F.lit(float(i + 1)).alias("step"), F.lit(d).alias("description"), t.alias("reasoning")) for i, (d, t) in enumerate(zip(STEPS, texts, strict=True))))


def rationale(answer: Column, kind: Column, excerpts: Column, quoted: int = 2) -> Column:
    """A sentence on the answer that quotes its first excerpts."""
    quotes = F.array_join(F.transform(F.slice(excerpts, 1, quoted), lambda e: F.concat(F.lit('"'), e, F.lit('"'))), " and ")
    return F.concat(F.lit("Selected "), answer, F.lit(" ("), kind, F.lit(" match)"), F.when(F.size(excerpts) > 0, F.concat(F.lit(", supported by "), quotes)).otherwise(F.lit(", without direct support")))
