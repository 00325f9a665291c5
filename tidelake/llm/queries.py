"""The registered queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.llm import (op1_licenses, op2_substring, op3_suffixes, op4_rules, op5_classes, op6_mixture, op7_jaccard,
                          op8_lines, op9_decontaminate, op10_forest, op11_merkle, op12_packing, op13_interactions)
from tidelake.llm.exchange import small_batches
from tidelake.plans.registry import table

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(fn):
        def run(spark, sf_dir):
            small_batches(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM w WHERE len(words) >= 50),
win AS (SELECT doc_id, p, list_slice(words, p, p + 49) AS key FROM spots),
least AS (SELECT key, min(doc_id) AS first_id FROM win GROUP BY key),
hit AS (SELECT win.doc_id, win.p FROM win JOIN least ON win.key = least.key AND win.doc_id > least.first_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM hit),
kept AS (SELECT w.doc_id, t.k, w.words[t.k] AS word FROM w, unnest(range(1, len(w.words) + 1)) AS t(k)
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.k = t.k)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN texts ON w.doc_id = texts.doc_id
""")
def op2_substring_dedup(spark, sf_dir):
    return op2_substring.dedup_passages(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


@query()
def op3_suffix_dedup(spark, sf_dir):
    return op3_suffixes.dedup_bytes(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query()
def op1_license_scan(spark, sf_dir):
    return op1_licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op4_rule_ensemble(spark, sf_dir):
    return op4_rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_class_bigrams(spark, sf_dir):
    return op5_classes.score_texts(table(spark, sf_dir, "documents"))


@query("""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM src),
w AS (SELECT *, (1 + sid % 3)::DOUBLE AS weight, 3 * source_size AS most, 3 * source_size / (1 + sid % 3)::DOUBLE AS level FROM num),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY level, sid ROWS BETWEEN UNBOUNDED PRECEDING
                                                                       AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY level, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS common FROM w),
g AS (SELECT sid, source, source_size, least(most::DOUBLE, weight * (SELECT arg_min(common, (level, sid)) FROM c WHERE common <= level))
             AS target FROM c),
b AS (SELECT sum(source_size)::BIGINT AS total, greatest(1, least(4096, greatest(
             floor(min(target) FILTER (target > 0) / 500), ceil(sum(source_size)::DOUBLE / 2097152))))::BIGINT AS block FROM g),
ranges AS (SELECT sid, low, lead(low, 1, 2.0) OVER (ORDER BY low, sid) AS high FROM (
           SELECT sid, target, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                               / sum(target) OVER () AS low FROM g) WHERE target > 0),
slots AS (SELECT i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS point
          FROM b, unnest(range(ceil(total::DOUBLE / block)::BIGINT)) AS t(i)),
counts AS (SELECT sid, count(*) AS n FROM slots JOIN ranges ON point >= low AND point < high GROUP BY sid),
streams AS (SELECT g.*, least(coalesce(n, 0) * block, 3 * source_size) AS stream FROM g CROSS JOIN b LEFT JOIN counts ON g.sid = counts.sid),
laid AS (SELECT s.*, source_size, target, stream, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5('mix:' || doc_id), doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
         FROM s JOIN streams ON s.source IS NOT DISTINCT FROM streams.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(size, stream - start)) + greatest(0, least(size, stream - start - source_size))
       + greatest(0, least(size, stream - start - 2 * source_size)))::BIGINT AS taken FROM laid
""")
def op6_source_mix(spark, sf_dir):
    return op6_mixture.mix(table(spark, sf_dir, "documents"))[0].drop("source")


@query()
def op7_jaccard_join(spark, sf_dir):
    return op7_jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("representative")


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (SELECT doc_id, n, line,
                 translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, n, line, keeper IS NOT NULL AND doc_id < keeper AS gone
           FROM keyed LEFT JOIN common ON keyed.key = common.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op8_line_dedup(spark, sf_dir):
    return op8_lines.dedup_lines(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text", "keep")


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
tests AS (SELECT DISTINCT item_id, len(key) AS size, key FROM (
          SELECT item_id, list_slice(words, p, p + least(len(words), 10) - 1) AS key
          FROM b, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS t(p) WHERE len(words) > 0)),
spans AS (SELECT DISTINCT size FROM tests),
spots AS (SELECT doc_id, p, size, list_slice(words, p, p + size - 1) AS key
          FROM d, spans, unnest(range(1, len(words) - size + 2)) AS t(p)),
hits AS (SELECT doc_id, p, spots.size, item_id FROM spots JOIN tests ON spots.key = tests.key),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(w.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words w ON d.doc_id = w.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
""")
def op9_decontamination(spark, sf_dir):
    found = op9_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return found.drop("spans", "clean_text")


@query()
def op10_isolation_forest(spark, sf_dir):
    return op10_forest.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f1,
       coalesce(strlen(source) || ':' || source, '-') AS f2, coalesce(strlen(lang) || ':' || lang, '-') AS f3, n_chars,
       coalesce(strlen(text) || ':' || text, '-') AS f5 FROM documents),
h AS (SELECT doc_id, lang, f1 || f2 || f3 AS head, f5, n_chars FROM d),
bytes AS (SELECT range AS b, range AS r0 FROM range(256)),
crc_table(b, k, c) AS (SELECT b, 0, b::BIGINT FROM bytes UNION ALL
       SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc_table WHERE k < 8),
t8 AS (SELECT b, c FROM crc_table WHERE k = 8),
crc(doc_id, i, c) AS (SELECT DISTINCT doc_id, 1, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL
       SELECT crc.doc_id, i + 1, xor(crc.c >> 8, t8.c) FROM crc JOIN t8 ON t8.b = xor(crc.c & 255, ascii(substr(crc.doc_id::VARCHAR, i, 1)))
       WHERE i <= length(crc.doc_id::VARCHAR)),
marked AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % 7 = 0 AS tampered FROM crc WHERE i = length(doc_id::VARCHAR) + 1),
hashed AS (SELECT h.doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || f5) AS leaf,
       sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || f5) AS other,
       coalesce(tampered, false) AS tampered FROM h LEFT JOIN marked ON h.doc_id = marked.doc_id),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
       count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM hashed),
tree(lang, level, pos, n, x) AS (SELECT lang, 0, pos, n, leaf FROM leaves UNION ALL
       SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY pos)) FROM tree WHERE n > 1
       GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, x, level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
tops(level, pos, n, x) AS (SELECT 0, pos, n, x FROM subs UNION ALL
       SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
sib AS (SELECT l.id, t.level, t.pos < l.pos >> t.level AS before, t.x FROM leaves l JOIN tree t
        ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = xor(l.pos >> t.level, 1) WHERE t.n > 1
        UNION ALL SELECT l.id, s.level + t.level, t.pos < s.pos >> t.level, t.x FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
        JOIN tops t ON t.pos = xor(s.pos >> t.level, 1) WHERE t.n > 1),
ends AS (SELECT s.lang, s.x AS subroot, s.level + (SELECT max(level) FROM tops) AS levels, (SELECT x FROM tops WHERE n = 1) AS root FROM subs s),
folds(id, level, levels, x) AS (SELECT l.id, 0, e.levels, CASE WHEN tampered THEN other ELSE leaf END FROM leaves l JOIN ends e
        ON e.lang IS NOT DISTINCT FROM l.lang UNION ALL
        SELECT f.id, f.level + 1, levels, sha256(CASE WHEN before THEN s.x ELSE '' END || f.x || CASE WHEN NOT before THEN s.x ELSE '' END)
        FROM folds f LEFT JOIN sib s ON s.id = f.id AND s.level = f.level WHERE f.level < levels),
proofs AS (SELECT id, sha256(string_agg(x, '' ORDER BY level)) AS p FROM sib GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = root AS verified
FROM leaves l JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang JOIN folds f ON f.id = l.id AND f.level = f.levels
LEFT JOIN proofs ON proofs.id = l.id
""")
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, op11_merkle.leaf_hash(
        "doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    found = op11_merkle.manifest(docs, also=[altered])
    folded = op11_merkle.fold(F.coalesce("also_0", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", op11_merkle.proof_hash(F.col("proof")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_nnls_packing(spark, sf_dir):
    import public_tokenizers

    return op12_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
copies AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 2 * length(w.t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM w JOIN copies ON w.t = copies.t LEFT JOIN l ON w.doc_id = l.doc_id GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f)
      JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
gone AS (SELECT m.*, filter_order, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(filter_order, x))), 6) AS gone_at
         FROM m CROSS JOIN o),
steps AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, sum(n) FILTER (gone_at > step) AS kept, sum(n) FILTER (gone_at = step) AS removed,
          sum(n) FILTER (gone_at < step AND contains(fails, substr(filter_order, step, 1))) AS redundant,
          sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails, sum(good) FILTER (gone_at = step) AS good_lost,
          sum(toxic) FILTER (gone_at = step) AS toxic_lost FROM gone, unnest(range(1, 6)) AS t(step) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM steps
""")
def op13_filter_interactions(spark, sf_dir):
    masks = op13_interactions.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op13_interactions.interactions(masks)
