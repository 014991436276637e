"""Named queries of evidence matching: tiers of options in ranked passages. Passages are the first candidates of each
item with a line of clinical text added by id, options are the item's own text, the same without marks, and two lines
of the lists below, so that every tier is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.lineage import cut
from ..operators import lexicon_join as X
from ..operators import metrics as M
from ..operators import normalise as N
from ..operators import option_match as O
from ..operators import rerank as K
from ..operators import segmentation as G
from ..operators import semantic_match as S
from ..operators import understanding as D
from .cases import CASES, _list, _text, cases, pick
from .catalog import CAND, DIM, HASH, LABELS, RES, TOK, candidates, query, results, rounded

LINES = (
    "Treatment: give ceftriaxone 1 g daily as first therapy.", "Gentamicin is contraindicated in renal failure.\nAspirin 75 mg daily may be given.", "Background on magnesium sulfate; the risk of bleeding is low.",
    "Do not use morphine here; oxygen is appropriate and should be used.", "Known azithromycin allergy, adverse reaction.", "Dosage of oral paracetamol: 500 mg, avoid in liver failure.",
    "Medication was reviewed. Erythromycin stat.", "Supportive observation only.",
)
DRUG_OPTIONS = ("Ceftriaxone 1 g IV stat", "Gentamicin 5 mg/kg first", "Immediate magnesium sulfate", "Give aspirin, 75 mg daily", "Morphine 10 mg", "Erythromycin stat dose", "Oral paracetamol 500 mg", "Azithromycin for 3 days")
WORD_OPTIONS = ("Supportive observation with oxygen", "Bleeding risk with renal failure", "Reviewed medication daily", "First therapy: oxygen should be appropriate", "")


def passages_and_options(t):
    """(qid, doc_id, label, option, initial) with the prepared passage; a passage is prepared before options meet it."""
    ranked = candidates(t).where("rk <= 5").withColumn("place", F.col("qid") + F.col("doc_id")).withColumn("content", F.concat_ws(" ", "content", pick(LINES, "place")))
    seen = O.prepared(ranked.select("qid", "doc_id", "content", "query", (F.col("qid") % 2 == 0).alias("initial"))).drop("content")
    forms = F.array(F.col("query"), F.regexp_replace("query", "[.,]", ""), pick(DRUG_OPTIONS, "qid"), pick(WORD_OPTIONS, "qid"))
    return seen.select("*", F.posexplode(forms).alias("i", "option")).withColumn("label", F.element_at(F.array(*map(F.lit, LABELS)), F.col("i") + 1))


def _any(text, terms):
    return "(" + " OR ".join(f"contains({text}, {_text(w)})" for w in terms) + ")"


def _near(at, size, reach, terms):
    start = f"greatest(1, {at} - {reach})"
    return _any(f"substr(low, {start}, {at} + {size} + {reach} - {start})", terms)


def _words(x):
    return f"list_slice(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(map(_text, O.STOP))})), 1, 20)"


def _drug(x):
    return "CASE " + " ".join(f"WHEN contains({x}, '{d}') THEN '{d}'" for d in sorted(O.DRUGS, key=len, reverse=True)) + " END"


def _first(x, patterns, group):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', {group}), '')" for p in patterns) + ")"


def _begins(w, then):
    return f"CASE WHEN strpos(low, '{w}') = 1 THEN {then} ELSE strpos(low, '{w}') > 0 END"


def _clean(x):
    return f"regexp_replace({x}, '[!-/:-@\\[-`{{-~]', '', 'g')"


TIERS = f"""{CAND},
pp AS (SELECT qid, doc_id, qid % 2 = 0 AS initial, query, lower(concat_ws(' ', content, ({_list(LINES)})[1 + (qid + doc_id) % {len(LINES)}])) low FROM cand WHERE rk <= 5),
po AS (SELECT *, unnest([struct_pack(label := 'A', o := lower(query)), struct_pack(label := 'B', o := lower(regexp_replace(query, '[.,]', '', 'g'))), struct_pack(label := 'C', o := lower(({_list(DRUG_OPTIONS)})[1 + qid % {len(DRUG_OPTIONS)}])), struct_pack(label := 'D', o := lower(({_list(WORD_OPTIONS)})[1 + qid % {len(WORD_OPTIONS)}]))]) z FROM pp),
p1 AS (SELECT qid, doc_id, initial, low, z.label AS label, z.o AS o, {_words('low')} dw, {_words('z.o')} ow FROM po),
p2 AS (SELECT *, CASE WHEN o = '' THEN 1 ELSE strpos(low, o) END pos, {_drug('o')} named, coalesce({_drug('o')}, {_first('o', O.DRUG_FORMS, 1)}) drug, {_first('o', O.DOSES, 0)} dose FROM p1),
p3 AS (SELECT *, coalesce(strpos(low, drug), 0) dp, coalesce(contains(low, dose), false) dosed FROM p2),
p4 AS (SELECT *, {_near('dp', 'length(drug)', 200, O.NEAR_DRUG)} treated, {_begins('treatment', _begins('medication', "contains(low, 'key_medications')"))} protocol, contains({_clean('low')}, {_clean('o')}) AND length({_clean('o')}) > 10 AS clean,
  list_concat(list_filter(ow, lambda k: {_any('k', O.MEASURES)} OR {_any('k', O.ROUTES)} OR {_any('k', O.DRUGS)}), list_filter(list_transform(list_filter(string_split_regex(o, '\\s+'), lambda w: length(w) > 5), lambda w: {_drug('w')}), lambda d: d IS NOT NULL AND contains(low, d))) imp FROM p3),
p5 AS (SELECT *, CASE WHEN pos > 0 THEN 'exact' WHEN clean THEN 'clean' WHEN dp > 0 AND (protocol OR dosed OR treated) THEN 'drug' END tier, len(list_intersect(list_distinct(imp), list_distinct(dw))) shared, len(list_intersect(list_distinct(ow), list_distinct(dw)))::DOUBLE / nullif(len(list_distinct(ow)), 0) ratio0,
  coalesce(nullif(pos, 0), list_filter(list_transform(list_filter(string_split_regex(o, '\\s+'), lambda w: length(w) > 4), lambda w: strpos(low, w)), lambda i: i > 0)[1]) spot FROM p4),
p6 AS (SELECT *, CASE WHEN shared > 0 THEN least(1.0::DOUBLE, ratio0 + shared / greatest(1, len(imp))::DOUBLE * 0.4::DOUBLE) ELSE ratio0 END ratio,
  CASE tier WHEN 'exact' THEN CASE WHEN {_near('pos', 'length(o)', 100, O.NEAR_PHRASE)} THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END WHEN 'clean' THEN 0.95::DOUBLE WHEN 'drug' THEN CASE WHEN dosed AND treated THEN 0.99::DOUBLE WHEN dosed OR treated THEN 0.97::DOUBLE ELSE 0.95::DOUBLE END * CASE WHEN initial AND {_any('o', ('stat', 'immediate', 'first'))} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END END tier_score,
  CASE WHEN spot IS NULL THEN 1.0::DOUBLE {' '.join(f"WHEN {_near('spot', 'length(o)', 300, c)} THEN {f}::DOUBLE" for f, c in O.CONTEXTS.items())} ELSE 1.0::DOUBLE END context,
  {' OR '.join(f"(contains(low, '{w}') AND (len(list_filter(list_slice(ow, 1, 3), lambda k: contains(low, k) AND abs(strpos(low, k) - strpos(low, '{w}')) < 100)) > 0 OR (pos > 0 AND abs(pos - strpos(low, '{w}')) < 100) OR coalesce(len(list_filter(string_split(low, chr(10)), lambda y: contains(y, named) AND contains(y, '{w}'))) > 0, false)))" for w in O.WARNINGS)} against FROM p5),
p7 AS (SELECT *, CASE WHEN ratio > 0.5 THEN ratio WHEN ratio > 0.3 THEN ratio * 0.8::DOUBLE WHEN ratio > 0.15 THEN ratio * 0.7::DOUBLE ELSE 0 END kept FROM p6)"""


@query(f"WITH {TIERS} SELECT qid, doc_id, label, tier, round(tier_score, 6) tier_score, round(coalesce(kept, 0), 6) keyword_score, against, round(context, 6) context FROM p7")
def option_match_tiers(t):
    rows = O.pair_tiers(passages_and_options(t)).select("qid", "doc_id", "label", "tier", "tier_score", "keyword_score", "against", "context")
    return rounded(rows, "tier_score", "keyword_score", "context")


PIECES = "pm AS (SELECT qid, label, tier_score * context score, true supports FROM p7 WHERE tier IS NOT NULL UNION ALL SELECT qid, label, kept * context, true FROM p7 WHERE kept > 0 UNION ALL SELECT qid, label, 0.5, false FROM p7 WHERE against)"


@query(f"WITH {TIERS}, {PIECES} SELECT qid, label, count(*) FILTER (supports) n, count(*) FILTER (NOT supports) n_against, round(sum(score) FILTER (supports), 6) total, round(max(score) FILTER (supports), 6) best FROM pm GROUP BY qid, label")
def option_evidence_pieces(t):
    """Pieces of evidence by option, as the strength rule takes them."""
    yes = F.col("supports")
    out = O.matches(passages_and_options(t)).groupBy("qid", "label").agg(F.count_if(yes).alias("n"), F.count_if(~yes).alias("n_against"), F.sum(F.when(yes, F.col("score"))).alias("total"), F.max(F.when(yes, F.col("score"))).alias("best"))
    return rounded(out, "total", "best")


# ---- terms by name, synonym or likeness ----

SENSE_LINES = (
    "Severe discomfort now. Keep resting well. Angina was seen.", "Sample collection done. Acetaminophen is indicated.", "General overview. Zithromax dose as usual. Surgical team ready.",
    "Temperature is elevated. Tissue was sent. The risk is low.", "Avoid flagyl. Human touch. Shortness is noted!", "No change at all.",
)
SENSE_OPTIONS = ("Give asa 75 mg for chest discomfort", "Azithromycin 500 mg daily and specimen collection", "Tylenol for elevated temperature, 3 days", "An operation or surgical procedure", "Human insulin 10 times, precordial pain", "Metronidazole with shortness of breath", "Rest only")


def sense(t):
    """Passages and options; the corpus is ranked once, as both and all that follows start from what is written here."""
    ranked = cut(candidates(t).where("rk <= 5").select("qid", "doc_id", "content")).withColumn("place", F.col("qid") + F.col("doc_id"))
    passages = ranked.select("qid", "doc_id", F.concat_ws(" ", pick(SENSE_LINES, "place"), "content").alias("content"))
    rows = ranked.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("place", F.col("qid") + F.col("i"))
    return passages, rows.select("qid", F.element_at(F.array(*map(F.lit, LABELS)), F.col("i") + 1).alias("label"), pick(SENSE_OPTIONS, "place").alias("option"))


def _terms(x):
    named = ", ".join(f"list_filter({_list(names)}, lambda w: contains({x}, w))[1]" for names in S.GROUPS.values())
    units = ", ".join(f"regexp_extract_all({x}, '{p}', 1)" for p in S.UNITS)
    return f"list_distinct(list_filter(list_concat([{named}], {units}), lambda w: w IS NOT NULL))"


def _synonym(term, text):
    return "coalesce(" + ", ".join(f"CASE WHEN contains({term}, '{head}') THEN list_filter({_list(names)}, lambda w: contains({text}, w))[1] END" for head, names in S.GROUPS.items()) + ")"


def _context(low, found):
    start = f"greatest(1, strpos({low}, {found}) - 200)"
    window = f"substr({low}, {start}, strpos({low}, {found}) + length({found}) + 200 - {start})"
    return f"CASE WHEN strpos({low}, {found}) = 0 THEN 'unknown' " + " ".join(f"WHEN {_any(window, words)} THEN '{name}'" for name, words in S.CONTEXTS.items()) + " ELSE 'general' END"


def _location(low, found):
    at = f"(strpos({low}, {found}) - 1)"
    return f"CASE WHEN {at} < 0 THEN 'unknown' WHEN {at} < length({low}) * 0.2::DOUBLE THEN 'beginning' WHEN {at} < length({low}) * 0.6::DOUBLE THEN 'middle' ELSE 'end' END"


def _unit(name, keys, source):
    """Vectors of unit length, as the hashed vectors of the catalog."""
    return f"{name} AS (SELECT {keys}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) w FROM (SELECT {keys}, {HASH} bucket, count(*)::DOUBLE w FROM (SELECT {keys}, unnest({TOK('text')}) term FROM {source}) GROUP BY ALL))"


SENSE = f"""{CAND},
sp AS (SELECT qid, doc_id, concat_ws(' ', ({_list(SENSE_LINES)})[1 + (qid + doc_id) % {len(SENSE_LINES)}], content) content FROM cand WHERE rk <= 5),
so AS (SELECT qid, (['A', 'B', 'C', 'D'])[i + 1] AS label, ({_list(SENSE_OPTIONS)})[1 + (qid + i) % {len(SENSE_OPTIONS)}] AS option FROM (SELECT DISTINCT qid FROM cand), range(4) r(i)),
st AS (SELECT qid, label, unnest({_terms('lower(option)')}) term FROM so),
sn AS (SELECT qid, doc_id, content, lower(content) low, term, CASE WHEN contains(lower(content), term) THEN term ELSE {_synonym('term', 'lower(content)')} END named FROM sp JOIN (SELECT DISTINCT qid, term FROM st) USING (qid)),
s1 AS (SELECT qid, doc_id, term, named matched, CASE WHEN named = term THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END similarity, {_context('low', 'named')} context, {_location('low', 'named')} AS location FROM sn WHERE named IS NOT NULL),
sx AS (SELECT * FROM (SELECT qid, doc_id, low, unnest(range(len(k))) i, unnest(k) AS text FROM (SELECT qid, doc_id, lower(content) low, list_filter(list_transform(string_split_regex(content, '[.!?]\\s+'), lambda x: trim(x)), lambda x: length(x) > 10) k FROM sp))),
ss AS (SELECT DISTINCT term AS text, term FROM sn WHERE named IS NULL), {_unit('sv', 'qid, doc_id, i', 'sx')}, {_unit('tv', 'text', 'ss')},
sc AS (SELECT o.qid, o.doc_id, o.term, sv.i, sum(sv.w * tv.w) similarity FROM sn o JOIN tv ON tv.text = o.term JOIN sv ON sv.qid = o.qid AND sv.doc_id = o.doc_id AND sv.bucket = tv.bucket WHERE o.named IS NULL GROUP BY ALL HAVING round(sum(sv.w * tv.w), 9) >= 0.25),
s2 AS (SELECT sc.qid, sc.doc_id, term, substr(x.text, 1, 100) matched, similarity, {_context('x.low', 'lower(x.text)')} context, {_location('x.low', 'lower(x.text)')} AS location FROM sc JOIN sx x USING (qid, doc_id, i)),
sm AS (SELECT qid, label, doc_id, term, matched, similarity, context, location FROM st JOIN (SELECT * FROM s1 UNION ALL SELECT * FROM s2) USING (qid, term))"""


@query(f"WITH {SENSE} SELECT qid, label, doc_id, term, matched, round(similarity, 6) similarity, context, location FROM sm")
def semantic_term_matches(t):
    """Names, synonyms and like sentences; the threshold is the one that is used when nothing else is found."""
    return rounded(S.semantic_matches(*sense(t), 0.30, dim=DIM), "similarity")


WEIGHED = "similarity * CASE context " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in S.CONTEXT_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END * CASE WHEN similarity >= 0.95 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN location IN ('beginning', 'middle') THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"WITH {SENSE} SELECT qid, label, count(*) n_matches, count(DISTINCT doc_id) n_docs, round(least(1.0::DOUBLE, avg({WEIGHED}) * CASE WHEN count(DISTINCT doc_id) > 1 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 6) score FROM sm GROUP BY qid, label")
def multi_document_evidence(t):
    return rounded(S.over_documents(S.semantic_matches(*sense(t), 0.30, dim=DIM)), "score")


@query(f"WITH {SENSE}, mt AS (SELECT DISTINCT qid, term FROM st WHERE length(term) > 4), mh AS (SELECT DISTINCT qid, term FROM mt JOIN sp USING (qid) WHERE list_contains({_terms('lower(content)')}, term) OR {_synonym('term', 'lower(content)')} IS NOT NULL), ml AS (SELECT qid, list_sort(list(term)) k FROM mt ANTI JOIN mh USING (qid, term) GROUP BY qid) SELECT qid, coalesce(array_to_string(list_slice(k, 1, 3), ';'), '') missing FROM (SELECT DISTINCT qid FROM cand) LEFT JOIN ml USING (qid)")
def missing_concepts(t):
    """Concepts of all options of a question that none of its passages names."""
    passages, options = sense(t)
    return S.missing_concepts(options.select("qid", F.col("option").alias("text")), passages).select("qid", F.array_join("missing", ";").alias("missing"))


# ---- lexicons as tables ----

#: The groups that the catalog has as tables; a caller brings its own from files (sources.readers).
ENTRIES = [(term.lower(), name) for name, terms in (L.SYNONYMS | L.EXPANSIONS | S.GROUPS).items() for term in terms]
LEXICON = f"lx AS (SELECT term, grp, min(place) place FROM (VALUES {', '.join(f'({_text(t)}, {_text(g)}, {i})' for i, (t, g) in enumerate(ENTRIES))}) v(term, grp, place) GROUP BY term, grp)"


def lexicon(t):
    session = t("documents").sparkSession
    rows = ", ".join(f"({_text(w)}, {_text(g)}, {i})" for i, (w, g) in enumerate((x.replace("'", "\\'"), y) for x, y in ENTRIES))
    return session.sql(f"SELECT * FROM VALUES {rows} AS v(term, grp, place)")


def remarked(t):
    return cases(t).select(F.col("qid").alias("id"), F.concat_ws(" ", "case_text", "answer").alias("text"))


WORD = "'[\\p{L}\\p{N}_]'"
OPEN = f"(p[i] = '' AND i = 1 OR p[i] <> '' AND NOT regexp_matches(right(p[i], 1), {WORD})) AND (p[i + 1] = '' AND i + 1 = len(p) OR p[i + 1] <> '' AND NOT regexp_matches(left(p[i + 1], 1), {WORD}))"
TEXTS = f"{CASES}, tx AS (SELECT qid id, concat_ws(' ', case_text, answer) AS text, lower(concat_ws(' ', case_text, answer)) low FROM cs), {LEXICON}"
FOUND = f"{TEXTS}, fd AS (SELECT id, term, grp, place FROM tx JOIN lx ON contains(low, term))"


@query(f"WITH {FOUND} SELECT id, grp, arg_min(term, place) term, count(DISTINCT term) n FROM fd GROUP BY id, grp")
def lexicon_groups(t):
    """Groups with a term anywhere in a case, and the first such term."""
    return X.first_of_groups(X.contained_terms(remarked(t), lexicon(t)))


@query(f"WITH {TEXTS}, pt AS (SELECT id, term, grp, string_split(low, term) p FROM tx JOIN lx ON contains(low, term)) SELECT id, term, grp FROM pt WHERE len(list_filter(range(1, len(p)), lambda i: {OPEN})) > 0")
def lexicon_bounded_terms(t):
    return X.bounded_terms(remarked(t), lexicon(t)).select("id", "term", "grp")


@query(f"WITH {TEXTS}, tk AS (SELECT id, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+') k FROM tx), lr AS (SELECT term, grp, regexp_extract_all(term, '[\\p{{L}}\\p{{N}}_]+') r FROM lx), tp AS (SELECT id, k, unnest(range(len(k))) AS i FROM tk) SELECT id, i token, term, grp FROM tp JOIN lr ON k[i + 1] = r[1] AND list_slice(k, i + 1, i + len(r)) = r")
def lexicon_token_runs(t):
    return X.token_runs(remarked(t), lexicon(t)).select("id", F.col("at").alias("token"), "term", "grp")


@query(f"WITH {FOUND}, hd AS (SELECT id, grp, list(DISTINCT term) own, min(place) first FROM fd GROUP BY id, grp), mo AS (SELECT id, first, grp, term, row_number() OVER (PARTITION BY id, grp ORDER BY lx.place, term) k FROM hd JOIN lx USING (grp) WHERE NOT list_contains(own, term)), ad AS (SELECT id, string_agg(term, ' ' ORDER BY first, grp, k) extra FROM mo WHERE k <= 3 GROUP BY id) SELECT id, md5(concat_ws(' ', text, extra)) text_md5, length(concat_ws(' ', text, extra)) n FROM tx LEFT JOIN ad USING (id)")
def lexicon_injection(t):
    """Cases with synonyms of what they name added."""
    texts = remarked(t)
    out = X.injected(texts, lexicon(t), X.contained_terms(texts, lexicon(t)))
    return out.select("id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


# ---- terminology ----

NOTES = ("Newborn with sob, temp 39 c and 5mg IV stat.", "Pregnant, 2nd trimester; BP 90 mmHg, HR 120bpm, ECG normal.", "Chest pain, ECG: stemi? 250 ml over 2 h, 70kg.", "Cardiac arrest, emergency; glucose 220 mg/dL, 3 l.", "Child with fever, uti. No change.", "Nothing to add.")
#: Some synonyms as a file of them would give; the abbreviations are those of the queries.
ADDED = {"chest pain": ["angina", "chest discomfort", "precordial pain"], "fever": ["pyrexia", "febrile"], "glucose": ["blood sugar"]}


def _normalised():
    """The passes in the other dialect, which has no look-around. Abbreviations are words that no meaning holds, so one
    pass over the words is the fold; a number is a word, so the mark behind a unit is never needed by the next match."""
    cases_ = " ".join(f"WHEN '{k}' THEN '{k} {v}'" for k, v in L.ABBREVIATIONS.items())
    x = f"array_to_string(list_transform(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: CASE w {cases_} ELSE w END), '')"
    added = lambda x, table: f"replace({x}, '{table[0]}', '{' '.join([table[0], *table[1][:2]])}')"
    for row in ADDED.items():
        x = added(x, row)
    for unit, name in N.UNITS.items():
        x = f"regexp_replace({x}, '([0-9]+)\\s*{unit}($|[^\\p{{L}}\\p{{N}}_])', '\\1 {name}\\2', 'g')"
    for row in N.SPECIALTY.items():
        x = added(x, row)
    return x


@query(f"WITH nt AS (SELECT conv_id, turn, lower(concat_ws(' ', text, ({_list(NOTES)})[1 + (conv_id + turn) % {len(NOTES)}])) low FROM conversations) SELECT conv_id, turn, md5({_normalised()}) text_md5 FROM nt")
def normalised_notes(t):
    """Turns with a note added, after the four passes."""
    rows = t("conversations").withColumn("place", F.col("conv_id") + F.col("turn"))
    text = F.concat_ws(" ", "text", pick(NOTES, "place"))
    return rows.select("conv_id", "turn", F.md5(N.normalised(text, L.ABBREVIATIONS, ADDED)).alias("text_md5"))


# ---- bins, paragraphs, specialties, glossaries ----


@query(f"WITH {RES} SELECT floor(confidence * 10)::BIGINT bin, count(*) n, round(avg(is_correct::INT), 6) accuracy, round((floor(confidence * 10) + 0.5) / 10, 6) predicted FROM res WHERE is_correct IS NOT NULL GROUP BY floor(confidence * 10)")
def calibration_bins(t):
    """What a calibration chart draws: accuracy and the middle of each tenth that has rows."""
    return rounded(M.calibration_bins(results(t)), "accuracy", "predicted")


TOPICS = ("fever", "shock", "aspirin", "bleeding", "pneumonia")


@query(f"WITH {CASES}, pg AS (SELECT qid id, list_filter(list_transform(string_split_regex(replace(concat_ws(chr(10) || chr(10), case_text, answer), '. ', '.' || chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) k FROM cs), px AS (SELECT id, i AS pos, k[i + 1] p, k[i] AS before, k[i + 2] AS after FROM (SELECT id, k, unnest(range(len(k))) i FROM pg)) SELECT id, pos, md5(p) paragraph, {' + '.join(f"contains(lower(p), '{w}')::INT" for w in TOPICS)} score, md5(before) AS before, md5(after) AS after FROM px WHERE {_any('lower(p)', TOPICS)}")
def paragraph_topics(t):
    """Paragraphs that name a topic, with the ones around them."""
    text = F.replace(F.concat_ws("\n\n", "case_text", "answer"), F.lit(". "), F.lit(".\n\n"))
    rows = G.paragraph_scores(cases(t).select(F.col("qid").alias("id"), text.alias("text")), TOPICS, id_="id").where("score > 0")
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "score", *(F.md5(c).alias(c) for c in ("paragraph", "before", "after")))


EXCERPT = f"""{CASES}, eg AS (SELECT qid id, string_split_regex(replace(concat_ws(chr(10) || chr(10), case_text, answer), '. ', '.' || chr(10) || chr(10)), '\\n\\s*\\n') k FROM cs),
eh AS (SELECT id, list([i]::BIGINT[] ORDER BY s DESC, i) hits FROM (SELECT id, i, {' + '.join(f"contains(lower(k[i + 1]), '{w}')::INT" for w in TOPICS)} s FROM (SELECT id, k, unnest(range(len(k))) i FROM eg)) WHERE s > 0 GROUP BY id),
ek AS (SELECT id, list_reduce(hits, lambda a, x: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda j: abs(j - x[1]) <= 1)) = 0 THEN list_append(a, x[1]) ELSE a END, []::BIGINT[]) kept FROM eh),
ex AS (SELECT id, array_to_string(list_transform(kept, lambda i: array_to_string(list_slice(k, greatest(i, 1), least(len(k), i + 2)), chr(10) || chr(10))), chr(10) || chr(10) || '---' || chr(10) || chr(10)) t FROM ek JOIN eg USING (id))"""


@query(f"WITH {EXCERPT} SELECT id, length(t) n, md5(CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || '...' ELSE t END) excerpt_md5 FROM ex")
def topic_excerpts(t):
    """The greedy choice of paragraphs on a list of topics; cases that name none are left out."""
    text = F.replace(F.concat_ws("\n\n", "case_text", "answer"), F.lit(". "), F.lit(".\n\n"))
    rows = cases(t).select(F.col("qid").alias("id"), G.topic_excerpt(text, TOPICS).alias("t"), G.topic_excerpt(text, TOPICS, chars=1 << 30).alias("whole")).where("t <> ''")
    return rows.select("id", F.length("whole").cast("long").alias("n"), F.md5("t").alias("excerpt_md5"))


@query(f"WITH {CAND}, sf AS (SELECT qid, doc_id, rk was, CASE WHEN contains(lower(category), 'en') THEN 2 ELSE 0 END + {' + '.join(f"contains(lower(content), '{w}')::INT" for w in ('the', 'tion', 'that'))} fit FROM cand) SELECT qid, doc_id, fit::DOUBLE fit, row_number() OVER (PARTITION BY qid ORDER BY fit DESC, was) rk FROM sf")
def specialty_order(t):
    """Candidates by the fit to a specialty, earlier ranks deciding ties."""
    return K.by_specialty(candidates(t), "category", ("the", "tion", "that"), "en").select("qid", "doc_id", "fit", "rk")


GLOSSARY = {"BP": "blood pressure", "iv": "intravenous", "SpO2": "oxygen saturation", "RR": "respiratory rate"}


@query(f"WITH {CASES} SELECT qid, md5({'replace(' * len(GLOSSARY)}concat_ws(' ', case_text, answer){''.join(f", '{k}', '{v}')" for k, v in GLOSSARY.items())}) text_md5 FROM cs")
def glossary_texts(t):
    return cases(t).select("qid", F.md5(D.glossary_applied(F.concat_ws(" ", "case_text", "answer"), GLOSSARY)).alias("text_md5"))
