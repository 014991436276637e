"""Chunking, understanding, evidence, safety, sources and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import plugins
from tarn.operators import adjust, diagnosis, evidence, rerank, safety, segmentation, tagging, tuning, understanding
from tarn.plans import answers
from tarn.sources import readers, sinks
from tarn.streaming import events


def fold(parts, size, overlap):
    """The packing rule in plain Python."""
    done, now, n = [], [], 0
    for s in parts:
        if n + len(s) > size and now:
            done.append(" ".join(now))
            kept, m = [], 0
            for x in reversed(now):
                if m + len(x) > overlap:
                    break
                kept.insert(0, x)
                m += len(x)
            now, n = kept, m
        now.append(s)
        n += len(s)
    return done + ([" ".join(now)] if now else [])


@pytest.mark.parametrize(("sizes", "size", "overlap"), [((200, 200, 100, 500), 450, 120), ((10,) * 30, 45, 20), ((600,), 450, 120), ((100, 50, 100, 50, 400, 20), 250, 60), ((), 450, 120)])
def test_chunks_by_plain_fold(spark, sizes, size, overlap):
    parts = [chr(97 + i % 26) * n for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(segmentation.packed_sentences(F.col("p"), size, overlap).alias("c")).first().c == fold(parts, size, overlap)


def test_sections(spark):
    df = spark.createDataFrame([(1, "# One\na\nbb\n\n# Two\n# Three\nccc")], "doc_id long, text string")
    got = [(r.title, r.n_lines, r.n_chars) for r in segmentation.sections(df, header="^# ").orderBy("section").collect()]
    assert got == [("# One", 2, 3), ("# Three", 1, 3)]


def understand(spark, text):
    return understanding.understood(spark.createDataFrame([(text,)], "text string")).first()


def test_queries_are_understood(spark):
    assert "myocardial infarction" in understand(spark, "What is the treatment for MI?").expanded
    r = understand(spark, "65-year-old male with chest pain, elevated troponin, no fever")
    assert (r.demographics.age, r.demographics.gender, r.demographics.age_group) == (65, "male", "geriatric")
    assert "chest pain" in r.symptoms and "troponin" in r.tests and "fever" in r.negated
    r = understand(spark, "Patient with acute myocardial infarction and elevated troponin")
    assert (r.specialty, r.acuity) == ("cardiology", "emergency")
    assert understand(spark, "Follow-up for diabetes maintenance").acuity == "routine"
    assert understand(spark, "hello").specialty is None
    assert understand(spark, "give magnesium sulfate or aspirin").drug == "magnesium sulfate"
    q = spark.createDataFrame([("According to the Stroke Guide, what?",), ("plain",)], "t string").select(understanding.mentioned_guideline(F.col("t")).alias("g")).collect()
    assert [r.g for r in q] == ["stroke guide", None]
    v = understanding.variants(spark.createDataFrame([(1, "stemi with pain")], "qid long, text string")).orderBy("variant").collect()
    assert len(v) == 4 and v[0].variant_text == "stemi with pain"


DOCS = [(1, "Aspirin 325mg is the first-line treatment for acute MI.", "GL one guideline"), (2, "Morphine is contraindicated in respiratory depression.", "GL two guideline")]


def options_of(spark):
    options = spark.createDataFrame([(1, l, o) for l, o in zip("ABCD", ("Aspirin 325mg", "Morphine", "Insulin", "Oxygen"), strict=True)], "qid long, label string, option string")
    docs = spark.createDataFrame(DOCS, "doc_id long, content string, title string")
    return evidence.option_scores(evidence.pair_scores(options.crossJoin(docs)))


def test_the_supported_option_wins(spark):
    got = {r.label: r for r in options_of(spark).collect()}
    assert got["A"].direct == 1.0 and got["A"].n_sources >= 1 and got["B"].against == 1 and got["C"].total == 0
    assert got["A"].total > got["B"].total
    best = evidence.choose(options_of(spark)).first()
    assert best.selected == "A" and 0 <= best.confidence <= 1 and best.margin > 0


def test_strength_and_choice(spark):
    rows = [(1, "A", 0.9, True), (1, "A", 0.8, True), (1, "B", 0.4, True), (1, "B", 0.6, False), (1, "C", 0.2, False)]
    s = evidence.strength(spark.createDataFrame(rows, "qid long, label string, score double, supports boolean"))
    got = {r.label: (r.strength, r.match_type) for r in s.collect()}
    assert got["A"] == (1.0, "direct") and got["C"] == (0.0, "none") and got["B"][0] == 0.0
    assert evidence.select_by_strength(s).first().selected == "A"


def test_doubts_and_agreement(spark):
    df = spark.createDataFrame([("what treatment", "pain and fever", "aspirin tablets", ["insulin"], "aspirin is avoided; avoid aspirin tablets here")], "q string, k string, s string, o array<string>, c string")
    d = df.select(adjust.doubts(*(F.col(c) for c in "qksoc")).alias("d")).first().d
    assert (d.errors, d.missing, d.alternatives) == (1, 2, 0) and d.risk == pytest.approx(0.5)
    votes = df.select(adjust.agreement(F.lit("A"), F.lit("B"), F.lit("B")).alias("v")).first().v
    assert (votes.answer, votes.votes) == ("B", 2)


def test_safety_rules(spark):
    cases = spark.createDataFrame([(1, "Severe chest pain with asthma", "give propranolol and warfarin with aspirin"), (2, "cough", "rest")], "qid long, case_text string, answer string")
    flags = safety.red_flags(cases, spark.createDataFrame([("chest pain", "WARNING")], "term string, level string"))
    found = flags.unionByName(safety.contraindications(cases, spark.createDataFrame([("propranolol", "asthma")], "drug string, condition string")))
    found = found.unionByName(safety.interactions(cases, spark.createDataFrame([("warfarin", "aspirin")], "drug string, other string")))
    steps = spark.createDataFrame([("acs", "infarct", "ecg", "DANGEROUS")], "protocol string, keyword string, step string, level string")
    found = found.unionByName(safety.missing_steps(cases, steps, flags))
    got = {r.qid: (r.n_violations, r.level, r.safe) for r in safety.verdicts(cases, found).collect()}
    assert got == {1: (4, "DANGEROUS", False), 2: (0, "SAFE", True)}


def test_pruning_and_budget(spark):
    rows = spark.createDataFrame([(1, i, "x" * n, i) for i, n in ((1, 1500), (2, 1400), (3, 500), (4, 10))], "qid long, doc_id long, content string, rk int")
    kept = rerank.budgeted(rows, 3050).orderBy("rk").collect()
    assert [len(r.kept) for r in kept] == [1500, 1400, 153]
    weights = rerank.normalised_weights((0.7, 0.3, 0.4))
    assert sum(weights) == pytest.approx(1) and weights[0] == pytest.approx(0.5)


def test_occurrences_and_vitals(spark):
    texts = spark.createDataFrame([(1, "No fever today. Later chest pain and FEVER."), (2, None)], "doc_id long, text string")
    got = [(r.symptom, r.severity, r.negated) for r in tagging.occurrences(texts, {"fever": ("mild", ["fever"]), "chest pain": ("critical", ["chest pain"])}).collect()]
    assert got[0] == ("chest pain", "critical", True) or got[0][0] == "chest pain"
    assert ("fever", "mild", True) in got
    v = spark.createDataFrame([("HR 120, BP 80/50, temp 38.5, SpO2 91%",)], "t string").select(tagging.numbers(F.col("t")).alias("n")).first().n
    assert (v.heart_rate, v.systolic, v.temperature, v.spo2) == (120, 80, 38.5, 91)
    assert spark.range(1).select(tagging.abnormal("heart_rate", F.lit("120")).alias("x"), tagging.abnormal("spo2", F.lit("bad")).alias("y")).first() == (True, False)


def test_grid_split_and_sample(spark):
    g = tuning.near_one(tuning.grid(spark, a=(0.3, 0.5, 0.7), b=(0.3, 0.5)), ("a", "b"), 0.01).collect()
    assert {(r.a, r.b) for r in g} == {(0.5, 0.5), (0.7, 0.3)}
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {(r.doc_id, r.fold) for r in tuning.split(rows, "doc_id").collect()}
    assert a == {(r.doc_id, r.fold) for r in tuning.split(rows.repartition(9), "doc_id").collect()}
    assert 0.75 < sum(f == "train" for _, f in a) / 2000 < 0.85
    assert [r.doc_id for r in tuning.sampled(rows, "doc_id", 5).collect()] == [r.doc_id for r in tuning.sampled(rows.repartition(3), "doc_id", 5).collect()]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "guideline_07_lung.txt").write_text("# Lung Care\nCategory: Pulmonology\nKeywords: asthma, copd\n\nTreatment and red flags. Dyspnea.")
    (tmp_path / "guideline_02_heart.txt").write_text("# Heart\n\ndiagnosis of chest pain")
    (tmp_path / "glossary_acs.txt").write_text("# Glossary\n\nSTEMI: full blockage: here\n")
    (tmp_path / "s.json").write_text('{"total_guidelines": 2, "guidelines": [{"id": 2, "name": "Heart", "category": "Cardio"}]}')
    got = {r.guideline_id: r for r in readers.guidelines(spark, str(tmp_path), str(tmp_path / "s.json")).collect()}
    assert set(got) == {"GL_007", "GL_002", "GLOSS_glossary_acs"}
    assert (got["GL_007"].title, got["GL_007"].category, got["GL_007"].keywords) == ("Lung Care", "Pulmonology", ["asthma", "copd"])
    assert got["GL_007"].section_tags == ["red_flags", "management"] and got["GL_007"].symptom_tags == ["dyspnea"]
    assert got["GL_002"].category == "Cardio" and got["GLOSS_glossary_acs"].title == "Glossary Acs"
    assert [(r.term, r.definition) for r in readers.glossary(spark, str(tmp_path)).collect()] == [("STEMI", "full blockage: here")]
    (tmp_path / "q.json").write_text('{"metadata": {}, "questions": [{"question_id": "a", "question": "Q", "options": ["x", "y"]}, {"question_id": "b", "question": "Q", "options": {"A": "x"}}]}')
    qs = {r.question_id: r.options for r in readers.cases(spark, str(tmp_path / "q.json")).collect()}
    assert qs == {"a": {"A": "x", "B": "y"}, "b": {"A": "x"}}
    (tmp_path / "syn.json").write_text('{"_metadata": {"n": 1}, "MI": ["Heart Attack", "AMI"]}')
    assert [(r.term, r.pos, r.synonym) for r in readers.synonyms(spark, str(tmp_path / "syn.json")).orderBy("pos").collect()] == [("mi", 0, "heart attack"), ("mi", 1, "ami")]
    (tmp_path / "exp.json").write_text('{"terms": [{"canonical": "Acute Pain", "aliases": ["AP", "hurt"], "categories": []}]}')
    assert {r.term: r.synonyms for r in readers.expansions(spark, str(tmp_path / "exp.json")).collect()} == {"acute pain": ["ap", "hurt"], "acute_pain": ["ap", "hurt"]}
    sinks.save_index(spark.range(3), str(tmp_path / "index"))
    assert readers.index(spark, str(tmp_path / "index")).count() == 3
    assert sinks.report({"a": spark.range(2), "b": spark.range(1)}).count() == 3
    s = readers.Settings.of({"retrieval": {"k1": 1.8, "weights": [1, 2, 3]}, "chunk_size": 300, "paths": {"raw": "x"}})
    assert (s.get("retrieval.k1"), s.get("chunk_size"), s.get("paths.raw"), s.get("none.such", 7)) == (1.8, 300, "x", 7)
    cut = readers.split_case(spark.createDataFrame([("", "x" * 120 + "? Which drug helps"), ("case", "short?")], "case_description string, question string")).collect()
    assert cut[0].question == "Which drug helps" and cut[1].question == "short?"


def test_plugins(spark):
    df = spark.createDataFrame([("ab", "text"), (None, None)], "q string, t string")
    assert [r.x for r in df.select(plugins.embedder(lambda: lambda xs: [[float(len(x))] for x in xs])("q").alias("x")).collect()] == [[2.0], [0.0]]
    assert [r.x for r in df.select(plugins.cross_scorer(lambda: lambda ps: [len(a) + len(b) for a, b in ps])("q", "t").alias("x")).collect()] == [6.0, 0.0]
    r = spark.range(1).select(plugins.parsed_answer(F.lit("The Answer: (b). Confidence: 85")).alias("x")).first().x
    assert (r.answer, r.confidence) == ("B", 0.85)


def test_answers(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    q = spark.createDataFrame([(1, "What is the treatment for acute MI?", "chest pain", {"A": "Aspirin 325mg", "B": "Morphine"}, "A"), (2, "zzz", None, {"A": "x"}, None)], "qid long, question string, case_description string, options map<string,string>, correct_answer string")
    got = {r.qid: r for r in answers.answered(q, docs).collect()}
    assert got[1].selected == "A" and got[1].is_correct and 0 < got[1].confidence <= 0.95
    assert got[2].selected == "Cannot answer" and got[2].confidence == 0 and got[2].is_correct is None


def test_streams_run_the_same_plan(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "click", 1.0, "{}") for i in range(40)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.source(spark, str(tmp_path / "in")), "10 minutes", "0 seconds")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(str(r.start), r.n) for r in spark.table("tumbled").collect()} == {(str(r.start), r.n) for r in events.tumbling(batch, "10 minutes").collect()}
    assert events.deduplicated(events.source(spark, str(tmp_path / "in"))).isStreaming


def test_differentials_steps_and_rationale(spark):
    found = spark.createDataFrame([(1, "chest pain"), (1, "Fever"), (2, "itch")], "qid long, symptom string")
    context = spark.createDataFrame([(1, "Myocardial infarction and pulmonary embolism"), (1, "Sepsis; pulmonary embolism")], "qid long, content string")
    got = [(r.place, r.diagnosis, round(r.support, 3)) for r in diagnosis.differentials(found, context).orderBy("place").collect()]
    assert got == [(1, "pulmonary embolism", 0.667), (2, "myocardial infarction", 0.333), (3, "sepsis", 0.333)]
    row = spark.createDataFrame([(["pain"], ["angina", "mi"], "A", ["Aspirin 300 mg"])], "s array<string>, d array<string>, a string, e array<string>")
    r = row.select(diagnosis.steps(*map(F.col, "sdae")).alias("steps"), diagnosis.rationale(F.col("a"), F.lit("direct"), F.col("e")).alias("why")).first()
    assert [s.description for s in r.steps] == list(diagnosis.STEPS) and r.steps[0].reasoning == "pain"
    assert "Aspirin 300 mg" in r.why


def test_sentence_windows(spark):
    text = "One two three. " * 30
    got = segmentation.sentence_windows(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string"), size=100, overlap=20).orderBy("doc_id", "window").collect()
    mine = [r for r in got if r.doc_id == 1]
    assert all(text[r.start : r.end].strip() == r.content for r in mine) and mine[0].content.endswith(".")
    assert all(b.start == a.end - 20 for a, b in zip(mine, mine[1:])) and mine[-1].end == len(text)
    assert [(r.doc_id, r.content) for r in got if r.doc_id > 1] == [(3, "short")]


def test_wrapped_paragraphs_are_whole(spark):
    from tarn.operators import segmentation

    text = "First line about Fever\nand its wrapped end with cough.\n \t\n\nNothing here.\n\n  Cough\nalone. \n"
    got = segmentation.paragraph_scores(spark.createDataFrame([(1, text)], "doc_id long, text string"), ("fever", "cough")).orderBy("pos").collect()
    assert [(r.pos, r.paragraph, r.score) for r in got] == [(0, "First line about Fever\nand its wrapped end with cough.", 2), (1, "Nothing here.", 0), (2, "Cough\nalone.", 1)]
    assert (got[1].before, got[1].after) == (got[0].paragraph, got[2].paragraph)


def test_lexicon_joins_by_brute_force(spark):
    """Three kinds of match, with terms of one and two characters, marks inside, repeats, nulls and empties."""
    import re

    from tarn.operators import lexicon_join as X

    texts = [(1, "St-elevation MI, then heart  attack; heart attack again"), (2, "mi amigo: pneumonia?"), (3, None), (4, ""), (5, "é heart_attack x"), (6, "Heart attack"), (7, "a.b a b")]
    terms = [("heart attack", "h", 0), ("attack", "h", 1), ("MI", "m", 2), ("st-elevation mi", "m", 3), ("x", "s", 4), ("", "s", 5), ("a b", "s", 6), ("heart attack", "h", 7), ("é", "e", 8), ("on", "e", 9)]
    df, lexicon = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, grp string, place long")
    words = sorted({(t.lower(), g) for t, g, _ in terms if t})
    low = {i: t.lower() for i, t in texts if t}
    got = lambda found: sorted((r.id, r.term, r.grp) for r in found.collect())
    assert got(X.contained_terms(df, lexicon)) == sorted((i, w, g) for i, t in low.items() for w, g in words if w in t)
    assert got(X.bounded_terms(df, lexicon)) == sorted((i, w, g) for i, t in low.items() for w, g in words if re.search(rf"\b{re.escape(w)}\b", t))
    runs = []
    for i, t in low.items():
        k = re.findall(r"\w+", t)
        for w, g in words:
            r = re.findall(r"\w+", w)
            runs += [(i, at, w, g) for at in range(len(k)) if k[at : at + len(r)] == r]
    assert sorted((r.id, r.at, r.term, r.grp) for r in X.token_runs(df, lexicon).collect()) == sorted(runs)
    found = X.contained_terms(df, lexicon)
    first = {(r.id, r.grp): (r.term, r.n) for r in X.first_of_groups(found).collect()}
    assert first[1, "h"] == ("heart attack", 2) and first[6, "h"] == ("heart attack", 2) and first[2, "m"] == ("mi", 1)
    more = {r.id: r.text for r in X.injected(df, lexicon, found).collect()}
    assert more[2].endswith(" st-elevation mi é") and more[4] == "" and len(more) == 7
    assert X.contained_terms(df, lexicon.limit(0)).count() == X.token_runs(df, lexicon.limit(0)).count() == 0


def test_terminology_by_plain_folds(spark):
    import re

    from tarn.functions import lexicon as L
    from tarn.operators import normalise as N

    added = {"fever": ["pyrexia", "febrile", "hot"], "pyrexia": ["burning"]}

    def fold(text):
        text = text.lower()
        for k, v in L.ABBREVIATIONS.items():
            text = re.sub(r"\b" + re.escape(k) + r"\b", f"{k} {v}", text)
        for table in (added, N.UNITS, N.SPECIALTY):
            for k, v in table.items():
                text = re.sub(r"(\d+)\s*" + re.escape(k) + r"\b", r"\1 " + v, text) if table is N.UNITS else text.replace(k, " ".join([k, *v[:2]]))
        return text

    assert not any(k in re.findall(r"\w+", v) for k in L.ABBREVIATIONS for j, v in L.ABBREVIATIONS.items() if j != k)
    texts = ["MI with fever 39C, 5mg/dl and 5 mg IV; 70kg, 3 l", "émi mi_x mi.", "newborn child in shock: emergency labor", "", "3 mmol/l 4mmol/L 5 mcg 6μg 7 grams", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(N.normalised(df.t, L.ABBREVIATIONS, added)).collect()]
    assert got == [t if t is None else fold(t) for t in texts]


def test_greedy_paragraphs_by_plain_python(spark):
    import random
    import re

    from tarn.operators import segmentation as G

    terms = ("fever", "Cough", "rash")

    def brute(text, chars):
        parts, hits = re.split(r"\n\s*\n", text), []
        for i, p in enumerate(parts):
            if n := sum(t.lower() in p.lower() for t in terms):
                hits.append((n, i))
        hits.sort(key=lambda x: -x[0])
        seen, out = set(), []
        for _, i in hits:
            if i not in seen:
                out.append("\n\n".join(parts[max(0, i - 1) : i + 2]))
                seen |= {i - 1, i, i + 1}
        got = "\n\n---\n\n".join(out[:10])
        return got[:chars] + "..." if len(got) > chars else got

    rng = random.Random(2)
    texts = ["\n\n".join(rng.choice(["fever", "cough RASH", "nothing", "", "Fever and cough and rash", "x\ny"]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "no hit", "fever"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chars in (5000, 90):
        assert [r[0] for r in df.select(G.topic_excerpt(df.t, terms, chars=chars)).collect()] == [brute(t, chars) for t in texts]
