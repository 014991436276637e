"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, edit_fingerprint, exact_dedup, html_text, jaccard_join, mixing, packing, prefix_trie, quality, suffix_dedup, token_alignment, token_count, url_filter

TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), max_repeat=3).select("doc_id", "size", "source_size", "target", "taken")


def op2_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), 20, queries=lambda i: i % 20 == 0)


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), 80, width=5).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op7_edit_fingerprint(spark, sf_dir):
    return edit_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def edit_near_texts(spark, sf_dir):
    """Near copies by the bands of operator 7, verified on the texts; no contract names it."""
    return edit_fingerprint.near_texts(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048)


def op10_token_count(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html_text, op3_url_filter, op4_ann, op5_jaccard_join, op6_quality, op7_edit_fingerprint, edit_near_texts, op8_suffix_dedup, op9_packing, op10_token_count, op11_prefix_trie, op12_token_alignment, op13_exact_dedup)}

SQL1 = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT h FROM documents),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 sid FROM (SELECT source, sum(size)::BIGINT source_size FROM s GROUP BY source)),
b AS (SELECT *, ([5.0, 2.0, 1.0])[1 + sid % 3]::DOUBLE weight, (3 * source_size)::DOUBLE lim FROM a),
c AS (SELECT *, lim / weight unit, (sum(source_size) OVER ())::DOUBLE total, coalesce(sum(lim) OVER (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) spent, sum(weight) OVER (ORDER BY lim / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) weight_left FROM b),
e AS (SELECT *, (total - spent) / weight_left level FROM c),
t AS (SELECT source, sid, source_size, least(lim, coalesce(weight * (SELECT level FROM e WHERE unit > level ORDER BY unit, sid LIMIT 1), lim)) target FROM e),
q AS (SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size) so_far FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
r AS (SELECT doc_id, h, size, source_size, target, coalesce((k * source_size + so_far)::DOUBLE / nullif(target, 0), 0) finish FROM q, range(3) x(k)),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, size) upto FROM r)
SELECT doc_id, size, source_size, target, (size * count(*) FILTER (upto <= (SELECT sum(size) FROM s)))::BIGINT taken FROM u GROUP BY doc_id, size, source_size, target
"""

SQL5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
m AS (SELECT a, min(b) least FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

SQL8 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) p FROM d WHERE len(h) >= 100)),
f AS (SELECT k, min(doc_id) least FROM w GROUP BY k),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END fresh FROM (SELECT DISTINCT w.doc_id, p FROM w JOIN f USING (k) WHERE least < w.doc_id)),
r AS (SELECT doc_id, min(p) a, max(p) + 50 z FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) run FROM g) GROUP BY doc_id, run),
s AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) before FROM r),
c AS (SELECT s.doc_id, count(*) n_spans, sum(z - a) n_removed, max(z) last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) kept FROM s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""

SQL11 = r"""
WITH t AS (SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) own FROM t GROUP BY c),
h AS (SELECT c, own, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT), lambda a, b: list_reduce(range(8), lambda q, i: xor(q >> 1, (q & 1) * 3988292384), xor(a, b)), 4294967295::BIGINT), 4294967295) % 6 h FROM k),
p AS (SELECT a.c, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) p FROM h a LEFT JOIN k b ON b.c = a.c - a.c % 100),
m AS (SELECT c, d, len(p) = d ends, CASE WHEN d > 0 THEN length(p[d].x) ELSE 0 END cp, sha256(array_to_string(list_transform(list_slice(p, 1, d), lambda y: length(y.r) || ':' || y.r || length(y.x) || ':' || y.x), '')) key FROM (SELECT c, p, unnest(range(0, len(p) + 1)) d FROM p)),
n AS (SELECT d, key, min(c) owner, count(*) n, max(cp) cp, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') ids FROM m GROUP BY d, key),
e AS (SELECT a.d, a.key, count(DISTINCT b.key) k FROM m a JOIN m b ON a.c = b.c AND b.d = a.d + 1 GROUP BY a.d, a.key),
s AS (SELECT m.d, m.key, sum((n.n - 1) * n.cp) v, count(*) FILTER (e.k IS NULL) l FROM n JOIN m ON m.c = n.owner AND m.d <= n.d LEFT JOIN e ON e.d = n.d AND e.key = n.key GROUP BY m.d, m.key)
SELECT n.owner conv_id, n.d depth, u.owner parent_conv_id, n.n n_convs, coalesce(e.k, 0)::BIGINT n_children, s.l n_leaves, s.v::BIGINT saved_tokens, sha256(n.ids) ends_sha256
FROM n JOIN s ON s.d = n.d AND s.key = n.key LEFT JOIN e ON e.d = n.d AND e.key = n.key LEFT JOIN m ON m.c = n.owner AND m.d = n.d - 1 LEFT JOIN n u ON u.d = m.d AND u.key = m.key
"""

SQL13 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') plain FROM documents),
k AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) keep_id, count(*) OVER (PARTITION BY plain) group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(plain) text_sha256 FROM k
"""

#: The others are not SQL: layout, models, walks, sequences and byte pairs; and the index of op4 is approximate.
ORACLE_SQL: dict[str, str] = {"op1_mixing": SQL1, "op5_jaccard_join": SQL5, "op8_suffix_dedup": SQL8, "op11_prefix_trie": SQL11, "op13_exact_dedup": SQL13}
