"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.chat import render
from panelcast.llm.collocations import collocations
from panelcast.llm.decontaminate import find_matches
from panelcast.llm.html_content import extract
from panelcast.llm.language import fit, predict
from panelcast.llm.license_scan import NOTICES, scan, template_words
from panelcast.llm.ngram_join import similar_groups
from panelcast.llm.packing import pack_documents
from panelcast.llm.periodic_runs import find_runs
from panelcast.llm.quality import judge
from panelcast.llm.registry import QUERIES, SQL, query  # noqa: F401
from panelcast.llm.sharding import contiguous_shards, document_sizes
from panelcast.llm.suffix_dedup import remove_repeats
from panelcast.llm.tables import table
from panelcast.llm.warc import read_archives, write_archives

ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op8_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT item, size, array_to_string(w[i : i + size - 1], ' ') AS key
        FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
docwin AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                 FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, i, docwin.size, item FROM docwin JOIN win USING (size, key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"),
                         keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SPACED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query("op2_ngram_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (g)
          WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
""")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).drop("text_key")


@query("op7_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    model = fit(docs.where("NOT held_out"))
    return predict(docs, model, keep=["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


CRC32 = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))"""


@query("op10_byte_balanced_shards", f"""
WITH crc_table AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) r(i)),
crc_list AS (SELECT list(e ORDER BY i) AS tab FROM crc_table),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, xor({CRC32}, 4294967295) AS text_crc32 FROM documents, crc_list),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(23, (24 * (2 * before + size)) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM s
""")
def byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = document_sizes(table(spark, sf_dir, "documents"), ["doc_id"])
    return contiguous_shards(sizes, "size", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_chat_formatting", """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS turns
           FROM conversations GROUP BY conv_id),
whole AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns),
inner_part AS (SELECT DISTINCT turns[1 : k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c))
SELECT conv_id, 0 AS part, len(turns) AS n_turns,
       array_to_string(list_transform(turns, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS text
FROM whole ANTI JOIN inner_part USING (turns)
""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


@query("op5_adaptive_quality_rules", r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(word_chars AS DOUBLE) / n_words AS a,
      CAST(n_symbols AS DOUBLE) / n_words AS s, CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS u,
      CAST(n_repeat_words AS DOUBLE) / n_words AS r FROM b),
q AS (SELECT lang, source, grouping(lang, source) AS id, count(*) AS n, quantile_disc(a, [0.1, 0.5, 0.9]) AS a,
      quantile_disc(s, [0.1, 0.5, 0.9]) AS s, quantile_disc(u, [0.1, 0.5, 0.9]) AS u, quantile_disc(r, [0.1, 0.5, 0.9]) AS r
      FROM f WHERE NOT base_failed GROUP BY ROLLUP (lang, source)),
k AS (SELECT f.*, coalesce(q0.a, q1.a, q2.a) AS qa, coalesce(q0.s, q1.s, q2.s) AS qs, coalesce(q0.u, q1.u, q2.u) AS qu, coalesce(q0.r, q1.r, q2.r) AS qr
      FROM f LEFT JOIN q q0 ON q0.id = 0 AND q0.n >= 100 AND q0.lang IS NOT DISTINCT FROM f.lang AND q0.source IS NOT DISTINCT FROM f.source
      LEFT JOIN q q1 ON q1.id = 1 AND q1.n >= 100 AND q1.lang IS NOT DISTINCT FROM f.lang LEFT JOIN q q2 ON q2.id = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(
    a <= greatest(qa[3] + 6 * (qa[3] - qa[2]), qa[2] + 1.0) AND a >= least(qa[1] - 6 * (qa[2] - qa[1]), qa[2] - 1.0)
    AND s <= greatest(qs[3] + 6 * (qs[3] - qs[2]), qs[2] + 0.2) AND u <= greatest(qu[3] + 6 * (qu[3] - qu[2]), qu[2] + 0.5)
    AND r <= greatest(qr[3] + 6 * (qr[3] - qr[2]), qr[2] + 0.1), false) AS kept
FROM k
""")
def adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])


def _license_sql() -> str:
    values = ", ".join("('{}', '{}', {}, {})".format(k, " ".join(w), len(w), min(5, len(w)))
                       for k, w in ((k, template_words(v)) for k, v in NOTICES.items()))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) v(license_id, words, n, size)),
ts AS (SELECT DISTINCT license_id, n, size, array_to_string(string_split(words, ' ')[i : i + size - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, n - size + 2)) AS i FROM t)),
total AS (SELECT license_id, count(*) AS n_shingles FROM ts GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)*') AS w FROM documents),
s AS (SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS g FROM (
      SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM ts) WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, license_id, n, g, i FROM s JOIN ts USING (size, g)),
win AS (SELECT doc_id, license_id, g, unnest(range(0, i + 1, (n + 1) // 2)) AS place, i, n FROM hit),
inside AS (SELECT doc_id, license_id, place, count(DISTINCT g) AS n_found FROM win
           WHERE i + least(5, n) <= place + n + (n + 1) // 2 - 1 GROUP BY ALL)
SELECT doc_id, license_id, count(*) AS n_windows, any_value(n_shingles) AS n_shingles, max(n_found) AS n_found, min(place) AS first_word
FROM inside JOIN total USING (license_id) WHERE 100 * n_found >= 80 * n_shingles GROUP BY doc_id, license_id"""


@query("op3_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_phrase_collocations", rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) s(k) WHERE len(w) >= k))
      GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
inner_part AS (SELECT lang, g, max(a) AS most FROM (
      SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
      SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) s(m) WHERE m < k)) GROUP BY 1, 2),
cut AS (SELECT c.lang, c.g, c.a, k, w, unnest(range(1, k)) AS place FROM c LEFT JOIN inner_part USING (lang, g)
        WHERE most IS NULL OR 100 * most < 100 * a),
scored AS (SELECT cut.lang, cut.g AS phrase, a, x.f AS l, y.f AS r, n, place,
           CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.g = array_to_string(w[1 : place], ' ')
           JOIN f y ON y.lang = cut.lang AND y.g = array_to_string(w[place + 1 :], ' ') JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op12_warc", """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("bigint").alias("refers_to"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    docs = docs.withColumn("w", F.expr(f"CASE WHEN h % 10 = 0 AND text IS NOT NULL THEN {words} END")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("IF(size(w) > 0, g % size(w), 0)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    again = "array_join(transform(w, (x, i) -> IF(i < a, x, w[int(a + (i - a) % p)])), ' ')"
    found = find_runs(docs.withColumn("text", F.expr(f"CASE WHEN w IS NOT NULL THEN {again} ELSE text END")), keep=["doc_id"])
    none = "cast(null as struct<start: bigint, length: bigint, period: bigint>)"
    found = found.withColumn("best", F.expr(
        f"aggregate(runs, {none}, (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"))
    listed = r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"))
