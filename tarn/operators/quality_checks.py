"""Further evaluation: context relevance, reasoning texts, option fallbacks, concept errors, recommendations, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that join steps of reasoning; words that mark an option as treatment; category keywords.
TRANSITIONS = ("because", "therefore", "thus", "hence", "however", "although", "furthermore", "additionally", "consequently", "given", "based")
TREATING = ("treatment", "therapy", "dose", "mg", "administer")
CATEGORY_WORDS = {
    "cardiology": ("heart", "cardiac", "chest pain", "mi", "stem", "troponin"),
    "gastroenterology": ("abdomen", "liver", "gi", "gastro", "hepatic"),
    "neurology": ("brain", "neurological", "seizure", "stroke", "cns"),
    "pulmonology": ("lung", "respiratory", "breathing", "pneumonia"),
    "nephrology": ("kidney", "renal", "nephro"),
    "endocrinology": ("diabetes", "glucose", "insulin", "thyroid"),
}
#: What error kinds call for, as codes in order; causes that hold whenever a kind occurs.
ADVICE = (
    ("retrieval", "entities"), ("retrieval", "synonyms"), ("reasoning", "structured_steps"), ("reasoning", "evidence_weights"), ("knowledge", "more_guidelines"),
    ("knowledge", "contraindications"), ("overconfidence", "calibration"), ("always", "query_expansion"), ("always", "domain_reranking"), ("always", "active_learning"),
)
CAUSES = {
    "retrieval": ("terminology", "missing_synonyms"), "reasoning": ("few_steps", "unweighted_evidence", "single_document", "missing_symptoms"),
    "knowledge": ("misread_guideline", "patient_factors", "contraindications", "misapplied_protocol"), "system": ("technical_failure", "index_files", "resources"),
}
#: Specialties that the corpus covers.
COVERED = ("Cardiology", "Gastroenterology", "Neurology")


def normalised_relevance(ranked: DataFrame) -> DataFrame:
    """qid, mean, high, medium, low: scores brought to 0..1 within the query (.5 if all are equal), in three bands."""
    one = W.partitionBy("qid")
    low, high = F.min("score").over(one), F.max("score").over(one)
    rows = ranked.withColumn("x", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(0.5)))
    return rows.groupBy("qid").agg(F.avg("x").alias("mean"), F.count_if(F.col("x") > 0.7).alias("high"), F.count_if(F.col("x").between(0.5, 0.7)).alias("medium"), F.count_if(F.col("x") < 0.5).alias("low"))


def context_relevance(question: Column, category: Column, content: Column) -> Column:
    """2 for a category whose words the question has, 1 for one whose words it lacks, else 1 for more than three shared words."""
    q, c = F.lower(question), F.lower(category)
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    named, asked = F.lit(False), F.lit(False)
    for name, terms in CATEGORY_WORDS.items():
        here = F.contains(c, F.lit(name))
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(q, F.lit(t))
        named, asked = named | here, asked | (here & hit)
    shared = F.size(F.array_intersect(words(question), words(content)))
    return F.when(asked, 2.0).when(named, 1.0).when(shared > 3, 1.0).otherwise(0.0)


def coherence(text: Column) -> Column:
    """Distinct joining words by 3, at most 1."""
    words = F.split(F.lower(text), r"\s+")
    return F.least(F.lit(1.0), F.size(F.array_intersect(words, F.array(*map(F.lit, TRANSITIONS)))) / F.lit(3.0))


def option_in_context(option: Column, context: Column) -> Column:
    """1 for the whole option in the lower-cased context, else its words over three letters that occur by all of
    them, 2 more for a drug by its ending; at most 1."""
    o = F.lower(option)
    ws = F.filter(F.split(o, r"\s+"), lambda w: F.length(w) > 3)
    drug = F.regexp_extract(o, r"\b([a-z]+(?:mycin|cycline|floxacin|penem|azole|pril|olol))\b", 1)
    hits = F.size(F.filter(ws, lambda w: F.contains(context, w))) + F.when((drug != "") & F.contains(context, drug), 2).otherwise(0)
    return F.when(F.contains(context, o), 1.0).when(F.size(ws) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.size(ws))))


def fallback_choice(options: DataFrame) -> DataFrame:
    """qid, selected, confidence by words only, from (qid, label, option, context): 1 for the whole option, else .2
    a word over three letters, .2 for a treatment word; the first best option, A if none scores."""
    o, c = F.lower("option"), F.lower("context")
    ws = F.filter(F.split(o, r"\s+"), lambda w: F.length(w) > 3)
    treats = F.lit(False)
    for t in TREATING:
        treats = treats | F.contains(o, F.lit(t))
    score = F.when(F.contains(c, o), 1.0).otherwise(0.2 * F.size(F.filter(ws, lambda w: F.contains(c, w)))) + F.when(treats, 0.2).otherwise(0.0)
    order = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "label")
    best = options.withColumn("score", score).withColumn("rk", F.row_number().over(order)).where("rk = 1")
    return best.select("qid", F.when(F.col("score") > 0, F.col("label")).otherwise("A").alias("selected"), F.least(F.lit(0.6), F.col("score") / 2).alias("confidence"))


def errors_by_concept(results: DataFrame, concepts: str = "concepts") -> DataFrame:
    """concept, n, accuracy, mean_confidence, sure_errors (over .8), unsure_errors (under .3)."""
    rows = results.select(F.explode(concepts).alias("concept"), "is_correct", "confidence")
    wrong = ~F.col("is_correct")
    return rows.groupBy("concept").agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.count_if(wrong & (F.col("confidence") > 0.8)).alias("sure_errors"), F.count_if(wrong & (F.col("confidence") < 0.3)).alias("unsure_errors"))


def recommendations(kinds: DataFrame, most: int = 10) -> DataFrame:
    """place, advice: what the error kinds found (error_kind; overconfidence may be one) call for, and what always holds."""
    spark = kinds.sparkSession
    table = spark.createDataFrame([(i, k, a) for i, (k, a) in enumerate(ADVICE)], "place int, error_kind string, advice string")
    found = kinds.select("error_kind").distinct().unionByName(spark.createDataFrame([("always",)], "error_kind string"))
    return table.join(found, "error_kind", "left_semi").orderBy("place").limit(most).select("place", "advice")


def quotas(spark: SparkSession, types: dict[str, int], levels: dict[str, int]) -> DataFrame:
    """type, level, n: each type's count dealt by percent, what is left over going to the medium level."""
    rows = []
    for t, n in types.items():
        dealt = {level: n * share // 100 for level, share in levels.items()}
        dealt["medium"] = dealt.get("medium", 0) + n - sum(dealt.values())
        rows += [(t, level, k) for level, k in dealt.items()]
    return spark.createDataFrame(rows, "type string, level string, n int")


def clean_option(text: Column) -> Column:
    """Option letters, list marks and surplus spaces taken off."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*(?:[A-Ea-e][.):]|[-*])\s*", ""), r"\s+", " "))


def root_causes(wrong: DataFrame) -> DataFrame:
    """error_kind, place, cause (codes) for wrong rows (error_kind, question, category). Failed retrievals are put
    down to vague questions if over .3 of them have under ten words, and to coverage if over .4 are of a specialty
    that is not covered."""
    few = F.size(F.filter(F.split(F.trim("question"), r"\s+"), lambda w: w != "")) < 10
    odd = ~F.coalesce(F.col("category").isin(*COVERED), F.lit(False))
    n = wrong.groupBy("error_kind").agg(F.count("*").alias("n"), F.count_if(few).alias("vague"), F.count_if(odd).alias("uncovered"))
    retrieval = F.col("error_kind") == "retrieval"
    causes = [F.when(retrieval & (F.col("vague") > 0.3 * F.col("n")), "vague_questions"), F.when(retrieval & (F.col("uncovered") > 0.4 * F.col("n")), "coverage")]
    causes += [F.when(F.col("error_kind") == k, c) for k, some in CAUSES.items() for c in some]
    return n.select("error_kind", F.posexplode(F.array_compact(F.array(*causes))).alias("place", "cause"))
