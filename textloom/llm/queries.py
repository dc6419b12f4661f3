"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .hard_negatives import hard_negatives
from .html_text import page_texts
from .language_id import identify_languages
from .line_dedup import drop_recurring_lines
from .merkle import digest, merkle_versions
from .minhash_dedup import near_duplicates
from .mixing import budget_sql, mix
from .secrets import secret_report
from .toxicity import toxicity
from .vector_dedup import near_vectors
from .warc import archive_report
from .winnowing import fingerprint_report


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of `pages` as a WARC record, read back from the archives."""
    return archive_report(table(spark, sf_dir, "pages"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * i}) & 31), 1)" for g in range(4) for i in range(8))
OP1_SQL = rf"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to FROM t
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the texts of `documents`, by fixed patterns and by the models."""
    return secret_report(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of `benchmark` stands in each of `documents`."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS t(i) WHERE len(words) > 0),
place AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM w, (SELECT DISTINCT n FROM win), unnest(range(1, len(words) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, place.n AS n, item_id FROM place JOIN win ON place.win = win.win AND place.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(w.words), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON w.doc_id = words.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each of `documents`."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents`, how many of them recur and go, and the md5 of what is left."""
    found = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines__").alias("n_lines"), F.col("n_dropped__").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP5_SQL = r"""
WITH line AS (SELECT doc_id, i, trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
masked AS (SELECT doc_id, i, p, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM line WHERE p <> ''),
form AS (SELECT doc_id, i, CASE WHEN contains(m, '<*>') AND len(list_filter(string_split(m, ' '), lambda t: NOT contains(t, '<*>') AND NOT regexp_matches(t, '[0-9]'))) < 0.5 * len(string_split(m, ' ')) THEN p ELSE m END AS m FROM masked),
per AS (SELECT m, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n_tokens, array_to_string(string_split(m, ' ')[1:3], ' ') AS head FROM (SELECT DISTINCT m FROM form)),
tok AS (SELECT m, n_tokens, head, len(list_filter(t[1:3], lambda x: NOT contains(x, '<*>') AND NOT regexp_matches(x, '[0-9]'))) AS n_head, unnest(t[4:]) AS token, generate_subscripts(t[4:], 1) AS pos FROM per),
stable AS (SELECT n_tokens, head, pos, token FROM tok JOIN form USING (m) WHERE NOT contains(token, '<*>') AND NOT regexp_matches(token, '[0-9]') GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
general AS (SELECT m, t.head || ' ' || string_agg(CASE WHEN s.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.pos) AS template FROM tok t LEFT JOIN stable s ON t.n_tokens = s.n_tokens AND t.head = s.head AND t.pos = s.pos AND t.token = s.token
 GROUP BY m, t.head, t.n_tokens, t.n_head HAVING count(s.token) < count(*) AND count(s.token) + t.n_head >= 0.5 * (count(*) + 3)),
named AS (SELECT per.m, n_tokens, CASE WHEN template IS NULL THEN 'line ' || per.m ELSE 'template ' || per.n_tokens || ' ' || template END AS template FROM per LEFT JOIN general ON per.m = general.m),
rec AS (SELECT template, min(doc_id) AS first_id FROM named JOIN form USING (m) GROUP BY template, n_tokens HAVING count(DISTINCT doc_id) >= CASE WHEN n_tokens >= 50 THEN 2 ELSE 10 END),
kept AS (SELECT k.doc_id, count(*) AS n_dropped, list(k.i) AS gone FROM form k JOIN named USING (m) JOIN rec USING (template) WHERE k.doc_id > rec.first_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped,
 md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END) AS text_md5
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def source_levels() -> dict[str, Column]:
    """Domain (the source's number mod 4), language, source."""
    number = F.expr(r"try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint)")
    return {"domain": F.concat(F.lit("domain"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def lang_weight(lang: Column) -> Column:
    return F.when(lang == "en", 5).when(lang.isin("de", "fr"), 2).otherwise(1)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that half of all tokens are spent on, by domain, language and source."""
    found = mix(table(spark, sf_dir, "documents"), source_levels(), total_share=(1, 2), weights={"lang": lang_weight})
    return found.select("doc_id", "lang", "source", F.col("n_tokens__").alias("n_tokens"), F.col("leaf_budget__").alias("leaf_budget"), F.col("epochs__").alias("epochs"))


OP6_SQL = rf"""
WITH d AS (SELECT *, 'domain' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4) AS domain, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{budget_sql(["domain", "lang", "source"], "tokens * 4", "SELECT sum(tokens) // 2 AS budget FROM leaves", {"lang": "CASE WHEN n.lang = 'en' THEN 5 WHEN n.lang IN ('de', 'fr') THEN 2 ELSE 1 END"})},
plan AS (SELECT l.domain, l.lang, l.source, b.budget, b.budget // tokens AS whole, b.budget % tokens AS rest FROM leaves l JOIN b3 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source WHERE b.budget > 0),
o AS (SELECT d.*, budget, whole, rest, md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS pos FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY pos, CAST(doc_id AS VARCHAR), md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS inside FROM o)
SELECT doc_id, lang, source, n_tokens, CAST(budget AS BIGINT) AS leaf_budget, CAST(whole + CASE WHEN inside THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM e WHERE whole > 0 OR inside
"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each of `pages`."""
    return page_texts(table(spark, sf_dir, "pages"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of `documents` and of their edited texts."""
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each of `documents`, learned from `labels`."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents` by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, and the versions that documents of an even crc32 make by losing their line breaks."""
    docs = table(spark, sf_dir, "documents")
    meta = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_versions(docs, digest(*meta, F.col("text")), digest(*meta, changed), F.col("source"), F.col("doc_id"), keep=["doc_id"])
    folded = F.element_at("copies", -1)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w))), lambda i: array_to_string(w[i:i + 1], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * shared >= 80 * (n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT comp.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id, comp.doc_id = component_id AS kept FROM comp LEFT JOIN s ON comp.doc_id = s.doc_id
"""


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"


_SIDES = """string_agg(h, '') OVER (PARTITION BY key, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
 string_agg(h, '') OVER (PARTITION BY key, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r"""
OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || source, '') AS key, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS meta, text,
 list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
 lambda a, c: list_reduce([xor(a, c)] || [CAST(0 AS BIGINT) FOR i IN range(8)], lambda x, z: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))) AS crc FROM documents),
e AS (SELECT doc_id, key, sha256(meta || {_field("text")}) AS leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(meta || {_field("replace(text, chr(10), '')")}) ELSE sha256(meta || {_field("text")}) END AS changed FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM e),
up AS (SELECT key, 0 AS level, pos AS idx, n, leaf AS h FROM o UNION ALL SELECT key, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY key, level, idx // 3, n),
subs AS (SELECT key, h, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (SELECT '' AS key, 0 AS level, pos AS idx, n, h FROM subs UNION ALL SELECT key, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY key, level, idx // 3, n),
sides AS MATERIALIZED (SELECT key, level, idx, {_SIDES} FROM up WHERE n > 1), tops AS MATERIALIZED (SELECT key, level, idx, {_SIDES} FROM above WHERE n > 1),
low AS (SELECT doc_id, key, leaf, 0 AS level, pos AS idx, changed AS f, '' AS proof FROM o
 UNION ALL SELECT doc_id, low.key, leaf, low.level + 1, low.idx // 3, sha256(coalesce(l, '') || f || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '') FROM low JOIN sides s ON low.key = s.key AND low.level = s.level AND low.idx = s.idx),
high AS (SELECT doc_id, low.key, leaf, 0 AS level, pos AS idx, f, proof FROM (SELECT *, row_number() OVER (PARTITION BY key, doc_id, leaf ORDER BY level DESC) AS last FROM low) low JOIN subs ON low.key = subs.key WHERE last = 1
 UNION ALL SELECT doc_id, high.key, leaf, high.level + 1, high.idx // 3, sha256(coalesce(l, '') || f || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '') FROM high JOIN tops s ON high.level = s.level AND high.idx = s.idx),
done AS (SELECT *, row_number() OVER (PARTITION BY key, doc_id, leaf ORDER BY level DESC) AS last FROM high)
SELECT doc_id, leaf, subs.h AS subroot, (SELECT h FROM above WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM above WHERE n = 1) AS verified FROM done JOIN subs ON done.key = subs.key WHERE last = 1
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of `embeddings`, whose labels are wrong for every seventh."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
 FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of `embeddings` with a cosine of 0.9 and more are linked."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT comp.vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.vec_id = component_id AS kept FROM comp LEFT JOIN n ON comp.vec_id = n.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_secrets": op2_secrets,
        "op3_decontaminate": op3_decontaminate,
        "op4_language_id": op4_language_id,
        "op5_line_dedup": op5_line_dedup,
        "op6_mixing": op6_mixing,
        "op7_html_text": op7_html_text,
        "op8_winnowing": op8_winnowing,
        "op9_toxicity": op9_toxicity,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_merkle": op11_merkle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_dedup": op13_vector_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_decontaminate": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op10_minhash_dedup": OP10_SQL, "op11_merkle": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_dedup": OP13_SQL}
