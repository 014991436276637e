"""Named queries of the rule tables, over cases made of the test tables: each document with a clinical remark and an
answer added by its id, so that the rules have something to find. Registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as R
from ..functions import text as T
from ..functions.lineage import cut
from ..operators import adjust as J
from ..operators import evidence as E
from ..operators import fusion as U
from ..operators import quality_checks as Z
from ..operators import rerank as K
from ..operators import safety as S
from ..operators import tagging as P
from ..operators import tuning as N
from ..operators import understanding as D
from .catalog import BOTH, CAND, DOUBLED, OPTIONS_SQL, REL, RES, SQ, _nested, _undoubled, bm25, candidates, options, query, relevant, results, rounded, vector

REMARKS = (
    "Sudden severe headache and neck stiffness with fever. BP: 180/110, HR 120.", "Known case of asthma, taking aspirin 75 mg daily. Denies chest pain.", "Septic shock, hypotension, temp 39.5, RR 28, SpO2 88% on room air.",
    "Pregnant woman, 32-year-old, vaginal bleeding and severe preeclampsia, history of pregnancy loss.", "Child, severe dehydration, no fever, creatinine 2.1, on gentamicin 5 mg.", "History of renal failure and heart failure; on potassium and lithium, ace inhibitors.",
    "Skin rash, pruritus; no shortness of breath; glucose 220 mg/dL, Hb 9.1, smoker.", "Routine follow-up.",
)
ANSWERS = (
    "Treat with ceftriaxone for 7 days. Give iv fluids and antibiotics.", "Give warfarin 5 mg/day and nsaids. Avoid beta blockers in asthma due to wheeze.", "Prescribe magnesium sulfate 4 g per hour, urgent delivery planning, monitoring.",
    "Administer ampicillin 50 mg/kg for 10 days; diagnosis confirmed pneumonia based on signs. Use aspirin 75 mg/day.", "Observe.",
)


def _list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


CASES = f"cs AS (SELECT doc_id qid, text || ' ' || ({_list(REMARKS)})[1 + doc_id % {len(REMARKS)}] case_text, ({_list(ANSWERS)})[1 + doc_id % {len(ANSWERS)}] answer, CASE WHEN doc_id % 3 = 0 THEN 'pediatric' WHEN doc_id % 7 = 1 THEN 'pregnancy' END category FROM documents WHERE text IS NOT NULL)"


def pick(items, key):
    return F.element_at(F.array(*map(F.lit, items)), (1 + F.col(key) % len(items)).cast("int"))


def cases(t):
    i = F.col("doc_id")
    rows = t("documents").where("text is not null")
    return rows.select(i.alias("qid"), F.concat_ws(" ", "text", pick(REMARKS, "doc_id")).alias("case_text"), pick(ANSWERS, "doc_id").alias("answer"), F.when(i % 3 == 0, "pediatric").when(i % 7 == 1, "pregnancy").alias("category"))


# ---- safety ----


def _values(name, columns, rows):
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(_text(x) for x in r) + ')' for r in rows)}) v({columns}))"


def _text(x):
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _any(text, terms):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in terms) + ")"


TABLES = ", ".join([
    _values("drg", "drug, cond", [(d, c) for d, cs in R.CONTRAINDICATED.items() for c in cs]), _values("cnd", "cond, drug", [(c, d) for c, ds in R.RULED_OUT.items() for d in ds]),
    _values("stp", "protocol, step, level", [(p, s, "DANGEROUS" if p in R.DANGEROUS_PROTOCOLS else "WARNING") for p, ss in R.PROTOCOLS.items() for s in ss]), _values("kwd", "protocol, word", [(p, w) for p in R.PROTOCOLS for w in p.split("_")]),
    _values("act", "a, b", R.INTERACTIONS), _values("ped", "drug", [(d,) for d in R.PEDIATRIC_DRUGS]),
])
VIOLATIONS = (
    f"{CASES}, {TABLES}, lc AS (SELECT qid, lower(case_text) c, lower(answer) a, category, {_any('lower(case_text)', [f for fs in R.RED_FLAGS.values() for f in fs])} flagged FROM cs), "
    "vi AS (SELECT qid, 'contraindication' kind, drug || '/' || cond detail, 'CRITICAL' AS level FROM lc JOIN drg ON contains(a, drug) AND contains(c, cond) "
    "UNION ALL SELECT qid, 'condition_contraindication', cond || '/' || drug, 'CRITICAL' FROM lc JOIN cnd ON contains(a, drug) AND (contains(c, cond) OR coalesce(category = cond, false)) "
    "UNION ALL SELECT qid, 'missing_emergency_step', s.protocol || ': ' || step, s.level FROM lc JOIN stp s ON NOT contains(a, step) AND NOT contains(c, step) WHERE flagged OR EXISTS (SELECT 1 FROM kwd k WHERE k.protocol = s.protocol AND contains(c, word)) "
    "UNION ALL SELECT qid, 'drug_interaction', x.a || '+' || x.b, 'CRITICAL' FROM lc JOIN act x ON contains(lc.a, x.a) AND contains(lc.c, x.b) "
    f"UNION ALL SELECT qid, 'pediatric_dosing', drug, 'WARNING' FROM lc JOIN ped ON contains(a, drug) WHERE category IN ('pediatric', 'neonatal') AND regexp_matches(a, '{R.DOSE_MENTION}') "
    f"UNION ALL SELECT qid, 'omitted_urgency', '', 'WARNING' FROM lc WHERE flagged AND NOT {_any('a', R.URGENCY)} "
    f"UNION ALL SELECT qid, 'missing_antibiotics', '', 'CRITICAL' FROM lc WHERE (contains(c, 'sepsis') OR contains(c, 'septic')) AND NOT {_any('a', R.ANTIBIOTICS)} "
    f"UNION ALL SELECT qid, 'missing_resuscitation', '', 'CRITICAL' FROM lc WHERE (contains(c, 'shock') OR contains(c, 'hypotension')) AND NOT {_any('a', R.FLUIDS)})"
)


@query(f"WITH {VIOLATIONS} SELECT * FROM vi")
def safety_rules(t):
    return S.rule_violations(cases(t))


@query(f"WITH {VIOLATIONS}, w AS (SELECT qid, count(*) n, CASE WHEN count(*) FILTER (level = 'DANGEROUS') > 0 THEN 'DANGEROUS' WHEN count(*) FILTER (level = 'CRITICAL') > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM vi GROUP BY qid) SELECT cs.qid, coalesce(n, 0) n_violations, coalesce(level, 'SAFE') AS level, coalesce(level, 'SAFE') IN ('SAFE', 'WARNING') safe FROM cs LEFT JOIN w USING (qid)")
def safety_levels(t):
    rows = cases(t)
    return S.assessed(rows, S.rule_violations(rows))


# ---- claims ----


def _all(p, g):
    return f"regexp_extract_all(r, '(?i){p}', {g})"


GROUNDED = "contains(ctx, lower(k)) OR (len(list_filter(string_split_regex(lower(k), '\\s+'), lambda w: length(w) > 4)) > 0 AND len(list_filter(string_split_regex(lower(k), '\\s+'), lambda w: length(w) > 4 AND contains(ctx, w))) >= 0.5 * len(list_filter(string_split_regex(lower(k), '\\s+'), lambda w: length(w) > 4)))"
DOSES = f"dm AS (SELECT qid, ctx, r, {_all(R.DOSE, 0)} m, string_split_regex(r, '(?i){R.DOSE}') p FROM rs), dx AS (SELECT qid, ctx, r, m, p, unnest(range(1, len(m) + 1)) i FROM dm WHERE len(m) > 0), dp AS (SELECT qid, ctx, m[i] mi, 1 + list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) pos, r FROM dx), dd AS (SELECT qid, ctx, list_filter({_list(R.DOSED)}, lambda d: contains(lower(substr(r, greatest(1, pos - 50)::BIGINT, least(pos - 1, 50)::BIGINT)), d))[1] drug, regexp_extract(mi, '^([0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE dose FROM dp), dn AS (SELECT qid, count(*) n_doses, count(*) FILTER (contains(ctx, drug) AND (contains(ctx, dose::VARCHAR) OR contains(ctx, floor(dose)::BIGINT::VARCHAR))) n_doses_named FROM dd WHERE drug IS NOT NULL GROUP BY qid)"
CLAIM = f"cl AS (SELECT qid, ctx, trim(unnest({' || '.join(_all(p, 1) for p in R.CLAIMS)})) k FROM rs), cc AS (SELECT qid, count(*) n_claims, count(*) FILTER ({GROUNDED}) n_grounded FROM cl GROUP BY qid)"
DURATIONS = f"du AS (SELECT qid, ctx, unnest({_all(R.DURATION, 1)}) n, unnest({_all(R.DURATION, 2)}) u FROM rs), dv AS (SELECT qid, count(*) FILTER (NOT (contains(ctx, n::INT || ' ' || u) OR contains(ctx, n::INT || ' ' || rtrim(u, 's')))) n_lacking FROM du GROUP BY qid)"


@query(f"WITH {CASES}, rs AS (SELECT qid, answer r, lower(case_text) ctx FROM cs), {CLAIM}, {DOSES}, {DURATIONS}, j AS (SELECT qid, coalesce(n_claims, 0) n_claims, coalesce(n_claims, 0) - coalesce(n_grounded, 0) + coalesce(n_lacking, 0) n_bad, coalesce(n_grounded, 0) + coalesce(n_doses, 0) n_good, coalesce(n_doses, 0) n_doses, coalesce(n_doses_named, 0) n_doses_named FROM rs LEFT JOIN cc USING (qid) LEFT JOIN dn USING (qid) LEFT JOIN dv USING (qid)) SELECT *, round(coalesce(n_bad / nullif(n_bad + n_good, 0)::DOUBLE, 0), 6) score, coalesce(n_bad / nullif(n_bad + n_good, 0)::DOUBLE, 0) > 0.3 OR n_bad >= 3 flagged FROM j")
def claim_checks(t):
    return rounded(E.checked_claims(cases(t).select("qid", F.col("answer").alias("reasoning"), F.col("case_text").alias("context"))), "score")


# ---- features of cases and queries ----


def _words(name):
    return " + ".join(f"contains(x, '{w}')::INT" for w in R.SPECIALTY_WORDS[name])


WINNER = "list_max([" + ", ".join(f"{{'n': {_words(k)}, 'i': {-i}, 'name': '{k}'}}" for i, k in enumerate(R.SPECIALTY_WORDS)) + "])"
FOCUS = "CASE name " + " ".join(f"WHEN '{k}' THEN list_filter({_list(v)}, lambda w: NOT contains(lower(answer), w))" for k, v in R.SPECIALTY_FOCUS.items()) + " ELSE [] END"


@query(f"WITH {CASES}, w AS (SELECT qid, answer, {WINNER} b, {' + '.join(_words(k) for k in R.SPECIALTY_WORDS)} total FROM (SELECT *, lower(case_text) x FROM cs)), n AS (SELECT qid, answer, CASE WHEN b.n > 0 THEN b.name ELSE 'general_medicine' END name, coalesce(b.n / nullif(total, 0)::DOUBLE, 0) confidence FROM w) SELECT qid, name specialty, round(confidence, 6) confidence, array_to_string([answer] || {FOCUS}, ' ') adapted FROM n")
def specialty_detection(t):
    d = D.detected_specialty(F.lower("case_text"), F.col("answer"))
    rows = cases(t).select("qid", d.alias("d")).select("qid", "d.*")
    return rounded(rows, "confidence")


def _first(ps):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(case_text, '(?i){p}', 1), '')" for p in ps) + ")"


def _firsts(table):
    return "concat_ws(' ', " + ", ".join(f"'{k}=' || {_first(ps)}" for k, ps in table.items()) + ")"


def _named(terms, forms):
    found = f"list_filter({_list(terms)}, lambda w: contains(x, w))"
    more = " || ".join(f"regexp_extract_all(x, '{p}', 1)" for p in forms)
    return f"array_to_string(list_sort(list_distinct({found} || list_filter(list_transform({more}, lambda w: trim(w)), lambda w: length(w) > 3))), ';')"


OUT = {"HR": "< 60 OR v > 100", "BP": "< 90 OR v > 140", "Temp": "< 36 OR v > 38", "RR": "< 12 OR v > 20", "SpO2": "< 95"}
ODD = "concat_ws(' ', " + ", ".join(f"CASE WHEN (TRY_CAST(regexp_extract({_first(R.VITALS[k])}, '^([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) {c.replace('v', f'''TRY_CAST(regexp_extract({_first(R.VITALS[k])}, '^([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE)''')}) THEN '{k}' END" for k, c in OUT.items()) + ")"


@query(f"WITH {CASES} SELECT qid, {_firsts(R.VITALS)} vitals, {_firsts(R.LABS)} labs, {ODD} abnormal, {_named(R.CHRONIC, R.CHRONIC_FORMS)} diseases, array_to_string(list_filter({_list(R.RISKS)}, lambda w: contains(x, w)), ';') risks, {_named(R.MEDICATIONS, R.MEDICATION_FORMS)} medications FROM (SELECT *, lower(case_text) x FROM cs)")
def case_feature_table(t):
    rows = P.case_features(cases(t))
    line = lambda m, table: F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), F.col(m)[k]) for k in table))
    return rows.select("qid", line("vitals", R.VITALS).alias("vitals"), line("labs", R.LABS).alias("labs"), F.array_join("abnormal", " ").alias("abnormal"), F.array_join("diseases", ";").alias("diseases"), F.array_join("risks", ";").alias("risks"), F.array_join("medications", ";").alias("medications"))


@query(f"WITH {CASES} SELECT qid, {_any('lower(answer)', R.COMPLEX)} complex FROM cs")
def complex_questions(t):
    return cases(t).select("qid", D.is_complex(F.col("answer")).alias("complex"))


SYMPTOMS = {"headache": ("moderate", ["headache", "head pain"]), "fever": ("moderate", ["fever"]), "chest_pain": ("critical", ["chest pain", "angina"]), "dyspnea": ("critical", ["shortness of breath", "dyspnea"]), "rash": ("mild", ["rash", "pruritus"])}
CUES = ("no ", "denies", "without", "absence of", "negative for", "not ", "ruled out", "free of")


def _places(symptom, severity, variants):
    # Both sides of a term are told by look-around in one engine and by the characters themselves in the other.
    p = "|".join(sorted(variants, key=len, reverse=True))
    return f"SELECT qid, x, '{symptom}' symptom, '{severity}' severity, pos FROM (SELECT qid, x, unnest(range(1, length(x) + 1)) pos FROM low WHERE regexp_matches(x, '{p}')) WHERE regexp_matches(substr(x, pos, 20), '^({p})($|[^a-z0-9_])') AND (pos = 1 OR NOT regexp_matches(substr(x, pos - 1, 1), '[a-z0-9_]'))"


@query(f"WITH {CASES}, low AS (SELECT qid, lower(case_text) x FROM cs), f AS ({' UNION ALL '.join(_places(k, s, v) for k, (s, v) in SYMPTOMS.items())}) SELECT qid, symptom, severity, pos - 1 AS position, {' OR '.join(f'''contains(substr(x, greatest(1, pos - 50), least(pos - 1, 50)), '{c}')''' for c in CUES)} negated FROM f")
def symptom_occurrences(t):
    return P.occurrences(cases(t), SYMPTOMS, id_="qid", text="case_text", cues=CUES)


KNOWN = f"list_filter({_list(L.SYMPTOMS)}, lambda w: contains(x, w))"
MORE = "list_sort(list_distinct(list_filter(flatten([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {_list(v)} ELSE [] END" for k, v in L.EXPANSIONS.items()) + "]), lambda w: NOT contains(lower(text), w))))"
FORMS = f"[text, x, text || ' ' || array_to_string({MORE}, ' '), array_to_string({KNOWN}, ' '), text || ' guideline management']"


@query(f"WITH v AS (SELECT item_id, text, {_undoubled(_nested(DOUBLED, L.ABBREVIATIONS))} x FROM benchmark), d AS (SELECT item_id, list_filter(list_transform({FORMS}, lambda f, i: {{'f': f, 'i': i}}), lambda s: length(trim(s.f)) > 0) fs FROM v), u AS (SELECT item_id, list_slice(list_transform(list_filter(fs, lambda s, j: len(list_filter(fs[1:j - 1], lambda q: q.f = s.f)) = 0), lambda s: s.f), 1, 4) fs FROM d) SELECT item_id, (generate_subscripts(fs, 1) - 1)::BIGINT variant, unnest(fs) variant_text FROM u")
def query_variants(t):
    return D.variants(t("benchmark")).select("item_id", "variant", "variant_text")


# ---- reranking, evidence and tuning ----

BOOSTED = f"{CAND}, bx AS (SELECT qid, doc_id, score, lower(content || ' ' || ({_list(ANSWERS)})[1 + doc_id % {len(ANSWERS)}]) low, lower(title) head, lower(query || ' ' || ({_list(REMARKS)})[1 + qid % {len(REMARKS)}]) x FROM cand), bd AS (SELECT *, list_distinct(list_filter({_list(R.DISEASES)}, lambda w: contains(x, w)) || list_filter([{', '.join('trim(regexp_extract(x, ' + _text(p) + ', 1))' for p in R.DISEASE_FORMS)}], lambda w: length(w) > 3)) ds FROM bx)"


def _sum(text, weights):
    return " + ".join(f"CASE WHEN contains({text}, '{k}') THEN {v}::DOUBLE ELSE 0 END" for k, v in weights.items())


BOOST = f"least(1.0::DOUBLE, {_sum('low', R.BOOST_PRIMARY)} + least(0.2::DOUBLE, {_sum('low', R.BOOST_SECONDARY)}) + " + " + ".join(f"CASE WHEN contains(low, '{k}') OR contains(head, '{k}') THEN {v}::DOUBLE ELSE 0 END" for k, v in R.BOOST_SECTIONS.items()) + " + CASE WHEN len(list_filter(ds, lambda d: contains(low, d) OR contains(head, d))) > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(ds, lambda d: contains(head, d))) > 0 THEN 0.2::DOUBLE ELSE 0 END)"


@query(f"WITH {BOOSTED}, bo AS (SELECT qid, doc_id, {BOOST} boost, score + {BOOST} score FROM bd) SELECT qid, doc_id, round(boost, 6) boost, round(score, 6) score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) rk FROM bo) WHERE rk <= 10")
def guideline_boosts(t):
    rows = candidates(t).drop("rk").withColumns({"content": F.concat_ws(" ", "content", pick(ANSWERS, "doc_id")), "query": F.concat_ws(" ", "query", pick(REMARKS, "qid"))})
    boost = K.term_boost(F.col("content"), F.col("title"), R.BOOST_PRIMARY, R.BOOST_SECONDARY, R.BOOST_SECTIONS, F.col("diseases"))
    rows = K.reranked(rows.withColumn("diseases", K.named_diseases(F.col("query"))), boost, 10)
    return rounded(rows.select("qid", "doc_id", "boost", "score", "rk"), "boost", "score")


PAIRS = (
    f"{OPTIONS_SQL}, pr AS (SELECT o.qid, label, lower(o.option) o, lower(content) low, lower(title) head, strpos(lower(content), lower(o.option)) pos FROM op o JOIN cand c ON c.qid = o.qid AND c.rk <= 5), "
    f"pw AS (SELECT *, list_distinct(list_filter(string_split_regex(o, '\\s+'), lambda w: length(w) > 0)) own, string_split_regex(low, '\\s+') ws FROM pr), ps AS (SELECT *, list_intersect(own, ws) sh FROM pw), "
    f"px AS (SELECT qid, label, CASE WHEN pos > 0 AND length(o) > 0 THEN CASE WHEN regexp_matches(substr(low, greatest(1, pos - 150), length(o) + least(pos - 1, 150) + 150), '{E.TREATMENT}') THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END END direct, "
    f"CASE WHEN len(sh) >= 1 THEN least(1.0::DOUBLE, len(sh) / greatest(1, len(own))::DOUBLE * (1 + 0.15::DOUBLE * len(list_intersect(sh, {_list(E.IMPORTANT)}))) * 1.5::DOUBLE) END inferred, "
    f"(pos > 0 AND ({' OR '.join(f'''(contains(low, '{p}') AND abs(pos - strpos(low, '{p}')) < 100)''' for p in E.AGAINST)}))::INT against, CASE WHEN pos > 0 AND contains(head, 'guideline') THEN 0.3::DOUBLE ELSE 0 END guide, (contains(low, 'guideline') OR contains(head, 'guideline'))::INT named FROM ps), "
    "pa AS (SELECT qid, label, coalesce(avg(direct), 0) * CASE WHEN count(direct) > 2 THEN 1.15 WHEN count(direct) > 1 THEN 1.12 ELSE 1 END::DOUBLE direct, coalesce(avg(inferred), 0) * CASE WHEN count(inferred) > 3 THEN 1.10 WHEN count(inferred) > 2 THEN 1.08 ELSE 1 END::DOUBLE inferred, max(against) against, least(1.0::DOUBLE, sum(guide)) align, count(direct) + count(inferred) n_sources, least(1.0::DOUBLE, sum(named * ((direct IS NOT NULL)::INT + (inferred IS NOT NULL)::INT)) / 3.0::DOUBLE) guideline FROM px GROUP BY ALL)"
)


@query(f"WITH {PAIRS} SELECT qid, label, round(direct, 6) direct, round(inferred, 6) inferred, against, round(align, 6) align, n_sources, round(guideline, 6) guideline, round(greatest(0, least(1, 0.6::DOUBLE * direct + 0.3::DOUBLE * inferred + 0.1::DOUBLE * align - 0.4::DOUBLE * against)), 6) total FROM pa")
def option_evidence(t):
    """Four options of each item against its five best documents."""
    best = cut(candidates(t).where("rk <= 5").select("qid", "doc_id", "content", "title"))  # the corpus is ranked once
    out = E.option_scores(E.pair_scores(options(t, best).join(best, "qid")))
    return rounded(out, "direct", "inferred", "align", "guideline", "total")


def _stages(triples, thresholds):
    settings = ", ".join(f"({i * len(thresholds) + j}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {x}::DOUBLE)" for i, (a, b, c) in enumerate(triples) for j, x in enumerate(thresholds))
    return (
        f"WITH {BOTH}, {REL}, gr AS (SELECT * FROM (VALUES {settings}) v(config, w1, w2, w3, least_)), x AS (SELECT qid, doc_id, a.score s1, CASE WHEN coalesce(c.score, 0) > 0 THEN 1 - 1 / (1 + c.score) ELSE 0 END s2 FROM a LEFT JOIN c USING (qid, doc_id)), "
        f"z AS (SELECT config, least_, qid, doc_id, w1, w2, w3, greatest(0, least(1, s1)) f, {SQ} g, greatest(0, least(1, w1 * s1 + w2 * s2)) h FROM x, gr), w AS (SELECT *, w1 * f + w2 * g + w3 * h base, (f > 0.6)::INT + (g > 0.6)::INT + (h > 0.6)::INT high FROM z), "
        "y AS (SELECT *, CASE WHEN high >= 2 THEN least(1.0, base * 1.1) ELSE base END score FROM w), sw AS (SELECT config, qid, doc_id, row_number() OVER (PARTITION BY config, qid ORDER BY round(score, 9) DESC, doc_id) rk FROM y WHERE score >= least_), n AS (SELECT qid, count(*) n_rel FROM rel GROUP BY qid), "
        "e AS (SELECT config, sw.qid, sum((rel.doc_id IS NOT NULL)::INT) / 5.0::DOUBLE p, coalesce(sum((rel.doc_id IS NOT NULL)::INT) / max(n_rel)::DOUBLE, 0) r, coalesce(max(CASE WHEN rel.doc_id IS NOT NULL THEN 1.0::DOUBLE / rk END), 0) rr FROM sw LEFT JOIN rel ON rel.qid = sw.qid AND rel.doc_id = sw.doc_id LEFT JOIN n ON n.qid = sw.qid WHERE rk <= 5 GROUP BY ALL), "
        "m AS (SELECT config, sum(p) / (SELECT count(*) FROM benchmark) AS precision, sum(r) / (SELECT count(*) FROM benchmark) recall, sum(rr) / (SELECT count(*) FROM benchmark) mrr FROM e GROUP BY config) "
        "SELECT config::BIGINT config, round(precision, 6) AS precision, round(recall, 6) recall, round(mrr, 6) mrr, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) + 0.3 * mrr, 6) objective FROM m"
    )


def swept(t, triples, thresholds):
    first = vector(t)
    pairs = K.keyword_stage(first, bm25(t), 20, (0.5, 0.2)).select("qid", "doc_id", "s1", "s2")
    out = N.swept_metrics(N.swept_stages(pairs, triples, 5, thresholds), relevant(t), t("benchmark").count(), 5)
    return rounded(out, "precision", "recall", "mrr", "objective")


@query(_stages(R.STAGE_WEIGHTS, (0.0,)))
def tune_stage_weights(t):
    return swept(t, R.STAGE_WEIGHTS, (0.0,))


@query(_stages(((0.5, 0.2, 0.3),), R.THRESHOLDS))
def tune_thresholds(t):
    return swept(t, ((0.5, 0.2, 0.3),), R.THRESHOLDS)


CAUSE_ROWS = _values("cz", "error_kind, i, cause", [(k, i, c) for k, cs in Z.CAUSES.items() for i, c in enumerate(cs)])


@query(f"WITH {RES}, k AS (SELECT CASE WHEN n_evidence = 0 THEN 'retrieval' WHEN n_steps = 0 THEN 'knowledge' ELSE 'reasoning' END error_kind, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) < 10 few, coalesce(category NOT IN {tuple(Z.COVERED)}, true) odd FROM res WHERE NOT is_correct), g AS (SELECT error_kind, count(*) n, count(*) FILTER (few) vague, count(*) FILTER (odd) uncovered FROM k GROUP BY 1), {CAUSE_ROWS}, u AS (SELECT error_kind, 0 o, 'vague_questions' cause FROM g WHERE error_kind = 'retrieval' AND vague > 0.3 * n UNION ALL SELECT error_kind, 1, 'coverage' FROM g WHERE error_kind = 'retrieval' AND uncovered > 0.4 * n UNION ALL SELECT error_kind, 2 + i, cause FROM g JOIN cz USING (error_kind)) SELECT error_kind, row_number() OVER (PARTITION BY error_kind ORDER BY o) - 1 place, cause FROM u")
def error_root_causes(t):
    kind = F.when(F.col("n_evidence") == 0, "retrieval").when(F.col("n_steps") == 0, "knowledge").otherwise("reasoning")
    return Z.root_causes(results(t).where(~F.col("is_correct")).select(kind.alias("error_kind"), F.col("text").alias("question"), "category"))



# ---- single rules: places of options, quotas, prefilter, boosts, sections, names ----

NAMED = ("aspirin", "nsaids", "antibiotics", "magnesium sulfate", "beta blockers", "lithium")
CONTEXTS = (("treatment|therapy|management|first-line", 1.3), ("contraindicat|avoid", 0.3), ("indicat", 1.2), ("complication|adverse", 0.8))


@query(f"WITH {CASES}, o AS (SELECT qid, lower(case_text || ' ' || answer) low, unnest({_list(NAMED)}) AS option FROM cs), p AS (SELECT *, strpos(low, option) pos FROM o WHERE contains(low, option)), a AS (SELECT *, substr(low, greatest(1, pos - 300), 600) around FROM p) SELECT qid, option, CASE {' '.join(f'''WHEN regexp_matches(around, '{p}') THEN {v}::DOUBLE''' for p, v in CONTEXTS)} ELSE 1.0::DOUBLE END factor, ({' OR '.join(f'''(contains(low, '{p}') AND abs(pos - strpos(low, '{p}')) < 100)''' for p in E.AGAINST)}) against FROM a")
def option_contexts(t):
    """Factor by the words around a named drug, and whether a warning stands near it."""
    rows = cases(t).select("qid", F.concat_ws(" ", "case_text", "answer").alias("content"), F.explode(F.array(*map(F.lit, NAMED))).alias("option"))
    rows = rows.withColumn("at", F.instr(F.lower("content"), F.col("option"))).where("at > 0")
    return rows.select("qid", "option", E.context_score(F.col("content"), F.col("at")).alias("factor"), E.contradicts(F.col("option"), F.col("content")).alias("against"))


@query(f"WITH {CAND} SELECT qid, doc_id, matched, round(score, 6) score, rk FROM (SELECT qid, doc_id, score, category = 'en' matched, row_number() OVER (PARTITION BY qid ORDER BY category = 'en' DESC, round(score, 9) DESC, doc_id) rk FROM cand) WHERE rk <= 5")
def quota_fill(t):
    rows = candidates(t).withColumn("matched", F.col("category") == "en")
    return rounded(U.quota(rows, "matched", 5).select("qid", "doc_id", "matched", "score", "rk"), "score")


PREFILTER = "pw AS (SELECT * REPLACE (list_sort(terms) AS terms), lower(content) low, string_split_regex(lower(content), '\\s+') ws FROM cand), pn AS (SELECT qid, doc_id, score, 2 * (len(terms) > 1 AND (contains(low, terms[1] || ' ' || terms[2]) OR (list_contains(ws, terms[1]) AND list_contains(ws, terms[2]))))::INT + len(list_filter(terms, lambda w: contains(low, w))) n FROM pw), pb AS (SELECT qid, doc_id, n, CASE WHEN n > 0 THEN least(1.0::DOUBLE, score + 0.15::DOUBLE * n) ELSE score END score FROM pn)"


@query(f"WITH {CAND}, {PREFILTER} SELECT qid, doc_id, n::BIGINT n, round(score, 6) score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n > 0 DESC, n DESC, round(score, 9) DESC, doc_id) rk FROM pb) WHERE rk <= 10")
def symptom_prefilter(t):
    """The first two long words of a query, by alphabet, as one critical term; all of them as terms."""
    critical = F.when(F.size("terms") > 1, F.array(F.array_join(F.slice(F.array_sort("terms"), 1, 2), " "))).otherwise(F.array().cast("array<string>"))
    rows = K.prefiltered(candidates(t).withColumn("critical", critical), 10)
    return rounded(rows.select("qid", "doc_id", F.col("n").cast("bigint").alias("n"), "score", "rk"), "score")


ASKED = "fx AS (SELECT qid, doc_id, lower(query || ' initial ' || category || CASE WHEN doc_id % 2 = 0 THEN ' treatment of ' ELSE ' ' END || title) q, category, lower(title || ' ' || title || ' initial') head, lower(content || CASE WHEN doc_id % 3 = 0 THEN ' First-line treatment' ELSE '' END) low FROM cand)"


@query(f"WITH {CAND}, {ASKED}, fn AS (SELECT *, len(list_filter(string_split_regex(head, '\\s+'), lambda w: length(w) > 3 AND list_contains(string_split_regex(q, '\\s+'), w))) n FROM fx) SELECT qid, doc_id, round(least(0.70::DOUBLE, CASE WHEN len(list_filter(string_split_regex(lower(category), '\\s+'), lambda w: length(w) > 0 AND contains(q, w))) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN n >= 2 THEN 0.30::DOUBLE WHEN n = 1 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN contains(q, 'initial') AND regexp_matches(q, 'treatment|therapy|management') AND regexp_matches(low, '(initial|first-line|primary) treatment|initial therapy') THEN 0.12::DOUBLE ELSE 0 END), 6) boost FROM fn")
def first_stage_boosts(t):
    i, title = F.col("doc_id"), F.col("title")
    asked = F.concat("query", F.lit(" initial "), "category", F.when(i % 2 == 0, " treatment of ").otherwise(" "), title)
    boost = K.first_stage_boost(asked, F.col("category"), F.concat(title, F.lit(" "), title, F.lit(" initial")), F.concat("content", F.when(i % 3 == 0, " First-line treatment").otherwise("")))
    return rounded(candidates(t).select("qid", "doc_id", boost.alias("boost")), "boost")


SECTION_RULES = {"red_flags": "red flag", "diagnosis": "diagnostic|diagnosis", "management": "treatment|management", "investigations": "investigation|ecg|troponin", "risk_stratification": "risk"}
OBSTETRIC, STRONG = ["pregnan", "vaginal bleeding", "preeclampsia", "urgent delivery"], ["preeclampsia", "pregnancy loss"]


def _count(text, terms):
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in terms) + ")"


@query(f"WITH {CASES}, x AS (SELECT qid, lower(case_text || ' ' || answer) low FROM cs), s AS (SELECT qid, low, least(1.0::DOUBLE, {_count('low', OBSTETRIC)} / {len(OBSTETRIC)}::DOUBLE + 0.2::DOUBLE * {_count('low', STRONG)}) score FROM x) SELECT qid, concat_ws(';', {', '.join(f'''CASE WHEN regexp_matches(low, '{p}') THEN '{k}' END''' for k, p in SECTION_RULES.items())}) sections, round(score, 6) obstetric, score > 0.1 positive, list_filter({_list(sorted(NAMED, key=len, reverse=True))}, lambda w: contains(low, w))[1] medication FROM s")
def case_labels(t):
    """Section tags, weighted obstetric terms and the longest drug name of a case with its answer."""
    text = F.concat_ws(" ", "case_text", "answer")
    rows = cases(t).select("qid", F.array_join(P.section_tags(text), ";").alias("sections"), P.weighted_terms(text, OBSTETRIC, STRONG).alias("w"), D.longest_first(F.lower(text), list(NAMED)).alias("medication"))
    return rounded(rows.select("qid", "sections", F.col("w.score").alias("obstetric"), F.col("w.positive").alias("positive"), "medication"), "obstetric")


FORMS_NAMED = (" Based on the Sepsis Bundle, what next?", " What is advised according to the \"Asthma Care\" guideline.", " Per the 'Stroke Unit' guideline, act.", " What next?")
NAMING = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '(?i){p}', 1), '')" for p in ("''([^'']+)'' guideline", '"([^"]+)" guideline', "based on the ([^,\\.]+)", "according to the ([^,\\.]+)", "per the ([^,\\.]+)")) + ")"


@query(f"SELECT doc_id, lower(trim({NAMING})) guideline FROM (SELECT doc_id, lang || ({_list(FORMS_NAMED)})[1 + doc_id % {len(FORMS_NAMED)}] x FROM documents)")
def guideline_mentions(t):
    return t("documents").select("doc_id", D.mentioned_guideline(F.concat("lang", pick(FORMS_NAMED, "doc_id"))).alias("guideline"))


# ---- excerpts and the last steps of an answer's confidence ----

QUERY_WORDS = f"list_slice(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(map(_text, T.STOP_WORDS))})), 1, 20)"


@query(f"WITH {CAND}, xl AS (SELECT qid, doc_id, query, content, lower(content) low, {QUERY_WORDS} ks FROM cand), xa AS (SELECT *, coalesce(nullif(strpos(low, lower(query)), 0), list_filter(list_transform(ks, lambda k: strpos(low, k)), lambda i: i > 0)[1]) pos FROM xl), xs AS (SELECT *, greatest(1, pos - 200) b, least(length(content), pos + 200) e FROM xa) SELECT qid, doc_id, CASE WHEN pos IS NULL THEN CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '...' ELSE content END ELSE CASE WHEN b > 1 THEN '...' ELSE '' END || substr(content, b, e - b + 1) || CASE WHEN e < length(content) THEN '...' ELSE '' END END excerpt FROM xs")
def candidate_excerpts(t):
    return candidates(t).select("qid", "doc_id", T.excerpt(F.col("query"), F.col("content")).alias("excerpt"))


LETTER = "(['A', 'B', 'C', 'D'])[1 + n_chars % {0}]".format
VOTE = f"vt AS (SELECT qid, confidence, {LETTER(4)} a, {LETTER(3)} b, CASE WHEN n_chars % 5 > 0 THEN {LETTER(2)} END c, n_chars % 3 > 0 grounded, n_chars % 7 > 2 safe, n_chars % 7 = 0 dangerous FROM res), vw AS (SELECT *, CASE WHEN a = b OR coalesce(a = c, false) THEN a WHEN b = c THEN b ELSE a END vote FROM vt), vn AS (SELECT *, (a = vote)::INT + (b = vote)::INT + coalesce((c = vote)::INT, 0) votes, CASE WHEN grounded THEN confidence ELSE confidence * 0.6::DOUBLE END x FROM vw), vx AS (SELECT qid, vote, votes, CASE WHEN dangerous THEN least(x, 0.2::DOUBLE) WHEN safe THEN least(0.95::DOUBLE, x * 1.05::DOUBLE) ELSE x END y FROM vn)"


@query(f"WITH {RES}, {VOTE} SELECT qid, vote AS answer, votes, round(CASE WHEN y < 0.65::DOUBLE AND votes < 2 THEN y * 0.8::DOUBLE WHEN y < 0.65::DOUBLE THEN least(0.7::DOUBLE, y * 1.1::DOUBLE) ELSE y END, 6) confidence FROM vx")
def voted_confidence(t):
    """Vote of three answers and what grounding, safety and agreement leave of the confidence."""
    n = F.col("n_chars")
    letter = lambda k: F.element_at(F.array(*map(F.lit, "ABCD")), (1 + n % k).cast("int"))
    rows = results(t).withColumn("v", J.agreement(letter(4), letter(3), F.when(n % 5 > 0, letter(2))))
    last = J.finished(F.col("confidence"), n % 3 > 0, n % 7 > 2, n % 7 == 0, F.col("v.votes") >= 2)
    return rounded(rows.select("qid", F.col("v.answer").alias("answer"), F.col("v.votes").alias("votes"), last.alias("confidence")), "confidence")
