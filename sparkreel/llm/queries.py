"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, exact_dedup, hard_negatives, langid, line_dedup, minhash, quality, simhash, sp_codec, substring_dedup, token_counts, toxicity
from .common import OWN, table


def digest_of(name: str):
    return F.sha2(F.col(name).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return removal_report(out, "n_sentences")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return removal_report(out, "n_lines")


def removal_report(out: DataFrame, name: str) -> DataFrame:
    """A row for each document that loses units. kept_in names a first occurrence without a doc_id by "null"."""
    return out.filter(F.col(f"{OWN}covered").isNotNull()).select(
        "doc_id", F.col(f"{OWN}units").alias(name), F.size(f"{OWN}covered").alias("n_removed"), F.array_join(f"{OWN}kept_in", ",", "null").alias("kept_in"), digest_of(f"{OWN}clean").alias("clean_sha256")
    )


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again: how many, the digest of the ids, and whether the text came back."""
    ids = sp_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip="round_trip")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5"), "round_trip")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "perplexity", "threshold", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of a contaminated document and the item that it holds."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.edits(conversations.damaged(table(spark, sf_dir, "conversations"))))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classify(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sentencepiece_codec": op2_sentencepiece_codec,
        "op3_language_id": op3_language_id,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_toxicity": op7_toxicity,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_line_dedup": op9_line_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_minhash_near_dedup": op12_minhash_near_dedup,
        "op13_hard_negatives": op13_hard_negatives,
    }


#: After the windows of each document: what is repeated, what goes, what is left.
REMOVAL = """
keyed AS (SELECT doc_id, pos, size, md5(run) AS key FROM windows),
firsts AS (SELECT key, min({'d': doc_id, 'p': pos}) AS f FROM keyed GROUP BY key HAVING count(*) > 1),
later AS (SELECT k.doc_id, k.pos, k.size, f.f.d AS kept FROM keyed k JOIN firsts f USING (key) WHERE NOT (f.f.d = k.doc_id AND f.f.p = k.pos)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + size)))) AS covered, array_to_string(list_sort(list_distinct(list(kept))), ',') AS kept_in FROM later GROUP BY doc_id)
"""


def words_sql(name: str, key: str) -> str:
    """The values (v) and the two templates (t0, t1) of a table's texts."""
    units = ", ".join(f"'{u}'" for u in decontam.UNITS)
    marked = r"regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g')"
    # matches don't overlap, so what stands between two digits is looked for twice
    twice = lambda x, sign, to: f"regexp_replace(regexp_replace({x}, '([0-9]){sign}([0-9])', '\\1' || {to} || '\\2', 'g'), '([0-9]){sign}([0-9])', '\\1' || {to} || '\\2', 'g')"
    numbers = twice(twice(f"lower({marked})", ",", "''"), "\\.", "chr(2)")
    number = r"regexp_full_match({}, '[0-9]+(\x02[0-9]+)*')"
    return rf"""
{name}_p AS (SELECT {key}, trim(regexp_replace(regexp_replace({numbers}, '[^\p{{L}}\p{{N}}\x01\x02]+', ' ', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g')) AS p FROM {name}),
{name}_w AS (SELECT {key}, list_filter(string_split(p, ' '), lambda x: x <> '') AS w, list_filter(string_split(replace(p, chr(1), ''), ' '), lambda x: x <> '') AS v FROM {name}_p),
{name}_n AS (SELECT {key}, w, v, list_transform(w, lambda x, i: CASE WHEN {number.format('x')} THEN '<number>' WHEN i > 1 AND v[i] IN ({units}) AND {number.format('w[i - 1]')} THEN '<unit>' ELSE x END) AS n FROM {name}_w),
{name}_t AS (SELECT {key}, v, list_transform(n, lambda x: replace(x, chr(1), '')) AS t0, list_transform(n, lambda x: CASE WHEN starts_with(x, chr(1)) THEN '<name>' ELSE x END) AS t1 FROM {name}_n)"""


#: Windows are compared as strings; sizes under 8 are those of shorter items.
DECONTAMINATION = "WITH " + words_sql("documents", "doc_id") + "," + words_sql("benchmark", "item_id") + r""",
b0 AS (SELECT item_id, t0, t1, v, least(len(v), 8) AS size, unnest(range(len(v) - least(len(v), 8) + 1)) AS beg FROM benchmark_t WHERE len(v) > 0),
b1 AS (SELECT item_id, size, beg, least(len(v) - size + 1, 2) AS need, t0[beg + 1 : beg + size] AS words, v[beg + 1 : beg + size] AS vals FROM b0
       UNION SELECT item_id, size, beg, least(len(v) - size + 1, 2), t1[beg + 1 : beg + size], v[beg + 1 : beg + size] FROM b0),
b2 AS (SELECT *, size < 8 OR 2 * len(list_filter(words, lambda x: x NOT IN ('<name>', '<number>', '<unit>'))) < size AS literal FROM b1),
b AS (SELECT item_id, words, need, literal, min(beg) AS beg, arg_min(vals, beg) AS vals, any_value(size) AS size FROM b2 GROUP BY item_id, words, need, literal, CASE WHEN literal THEN vals END),
d0 AS (SELECT doc_id, t0, t1, v, s.size, unnest(range(len(v) - s.size + 1)) AS pos FROM documents_t, (SELECT DISTINCT size FROM b) s WHERE len(v) >= s.size),
d AS (SELECT doc_id, pos, t0[pos + 1 : pos + size] AS words, v[pos + 1 : pos + size] AS own FROM d0
      UNION SELECT doc_id, pos, t1[pos + 1 : pos + size], v[pos + 1 : pos + size] FROM d0),
m AS (SELECT doc_id, item_id, pos, pos - beg AS shift, need, words, vals, own FROM d JOIN b USING (words) WHERE NOT literal OR vals = own),
slots AS (SELECT doc_id, item_id, shift, words[i] AS kind, vals[i] AS theirs, own[i] AS ours FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM m) WHERE words[i] IN ('<name>', '<number>', '<unit>')),
checked AS (SELECT doc_id, item_id, shift, count(DISTINCT (kind, theirs, ours)) = count(DISTINCT (kind, theirs)) AND count(DISTINCT (kind, theirs, ours)) = count(DISTINCT (kind, ours)) AS ok, bool_or(theirs <> ours) AS differ FROM slots GROUP BY ALL),
per AS (SELECT doc_id, item_id, shift, need, count(DISTINCT pos) AS n, count(DISTINCT CASE WHEN vals = own THEN pos END) AS exact FROM m GROUP BY ALL),
judged AS (SELECT doc_id, item_id, n, exact, coalesce(ok, true) AND n >= need AS good, coalesce(differ, false) AS differ FROM per LEFT JOIN checked USING (doc_id, item_id, shift))
SELECT doc_id, item_id, CAST(sum(CASE WHEN good THEN n ELSE exact END) AS BIGINT) AS n_windows, bool_or(good AND differ) AS reparameterised
FROM judged WHERE good OR exact > 0 GROUP BY doc_id, item_id
"""

#: Different sets meet by the shingles they share; each set's smallest reachable one is carried along links until nothing changes.
MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS s FROM w),
k AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) = 0 THEN NULL ELSE sha256(array_to_string(s, chr(10))) END AS node, s FROM s),
nodes AS MATERIALIZED (SELECT node, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k WHERE node IS NOT NULL GROUP BY node),
e AS (SELECT id, n, unnest(s) AS x FROM nodes),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (SELECT id, id AS least FROM nodes UNION SELECT l.b, r.least FROM reached r JOIN links l ON l.a = r.id WHERE r.least < l.b),
named AS (SELECT id, min(least) AS component_id FROM reached GROUP BY id)
SELECT k.doc_id, k.n AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id, k.doc_id = coalesce(c.component_id, k.doc_id) AS kept
FROM k LEFT JOIN nodes ON nodes.node = k.node LEFT JOIN named c ON c.id = nodes.id
"""

SQL = {
    "op1_substring_dedup": r"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?。！？…؟۔।\n]+[.!?。！？…؟۔।\n]*|[.!?。！？…؟۔।\n]+') AS u FROM documents),
b AS (SELECT doc_id, list_transform(u, lambda x: trim(x, E' \n')) AS v FROM s),
-- bytes from sentence a to the one before z, a line end between: c[z] - c[a] - 1, since c counts one for each sentence
flat AS (SELECT doc_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM b),
sums AS (SELECT doc_id, i, CAST(sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS c FROM flat),
lists AS (SELECT doc_id, [0] || list(c ORDER BY i) AS c FROM sums GROUP BY doc_id),
sized AS (SELECT doc_id, v, c FROM b JOIN lists USING (doc_id) WHERE len(v) >= 2),
places AS (SELECT doc_id, v, c, unnest(range(len(v))) AS i FROM sized),
runs AS (
SELECT doc_id, v, i AS pos, list_filter(range(i + 2, least(len(v), i + 102) + 1), lambda z: c[z + 1] - c[i + 1] - 1 >= 100)[1] AS z FROM places
UNION
SELECT doc_id, v, list_filter(range(greatest(i - 101, 0), i), lambda a: c[i + 2] - c[a + 1] - 1 >= 100)[-1] AS pos, i + 1 AS z FROM places),
windows AS (SELECT doc_id, pos, z - pos AS size, array_to_string(v[pos + 1 : z], E'\n') AS run FROM runs WHERE pos IS NOT NULL AND z IS NOT NULL),
""" + REMOVAL + """
SELECT s.doc_id, CAST(len(u) AS INTEGER) AS n_sentences, CAST(len(covered) AS INTEGER) AS n_removed, kept_in,
       sha256(coalesce(array_to_string(list_filter(u, lambda x, i: NOT list_contains(covered, i - 1)), ''), '')) AS clean_sha256
FROM s JOIN gone USING (doc_id)
""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""",
    "op8_benchmark_decontamination": DECONTAMINATION,
    "op12_minhash_near_dedup": MINHASH,
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 3
""",
    "op9_line_dedup": """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), E'\\n') AS u FROM documents),
starts AS (SELECT doc_id, u, unnest(range(len(u) - 2)) AS pos FROM s WHERE len(u) >= 3),
windows AS (SELECT doc_id, pos, 3 AS size, array_to_string(u[pos + 1 : pos + 3], E'\\n') AS run FROM starts),
""" + REMOVAL + """
SELECT s.doc_id, CAST(len(u) AS INTEGER) AS n_lines, CAST(len(covered) AS INTEGER) AS n_removed, kept_in,
       sha256(coalesce(array_to_string(list_filter(u, lambda x, i: NOT list_contains(covered, i - 1)), E'\\n'), '')) AS clean_sha256
FROM s JOIN gone USING (doc_id)
""",
}
