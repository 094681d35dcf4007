"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akshara.llm.decontamination import contaminated
from akshara.llm.fill_in_middle import fill_in_middle, restored
from akshara.llm.fingerprints import as_text, fingerprint_documents
from akshara.llm.jaccard_join import jaccard_components
from akshara.llm.language_id import fold, predict_language, train_network
from akshara.llm.packing import pack_documents
from akshara.llm.spelling_variants import variants_of_documents
from akshara.llm.substring_dedup import substring_dedup
from akshara.llm.suffix_dedup import suffix_dedup
from akshara.llm.token_counts import count_tokens
from akshara.llm.toxicity import score_toxicity, train_toxicity
from akshara.llm.url_filters import filter_urls
from akshara.llm.warc import read_warc, shared_folder, write_warc


#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d),
h AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 19), ' ') AS win FROM p),
late AS (SELECT doc_id, pos FROM h QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM late),
per AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)""",
    "op6_jaccard_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM d),
c AS (SELECT min(doc_id) AS rep, g, list(doc_id) AS ids FROM s WHERE len(g) > 0 GROUP BY g), t AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
e AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach), l AS (SELECT node, min(reach) AS component FROM r GROUP BY node), m AS (SELECT unnest(ids) AS doc_id, component FROM c JOIN l ON l.node = c.rep)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN m USING (doc_id)""",
    "op8_warc": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h), s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, last FROM p JOIN m USING (h)),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(x, 5 * k + 1, 5))::BIGINT) AS v FROM s)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(flatten(list_transform(v, lambda y: list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> k) & 31) + 1, 1)))), '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b""",
    "op10_suffix_dedup": r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), p AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 399)) AS pos, x FROM d WHERE length(x) >= 800),
h AS (SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, 800)) AS k FROM p), g AS (SELECT doc_id, pos FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
i AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 400 THEN 0 ELSE 1 END AS new FROM g), j AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM i),
s AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 400 AS b FROM j GROUP BY 1, 2), k AS (SELECT doc_id, span, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM s),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY span) AS front, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE front || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)""",
    # crc32 byte by byte, by a table of the remainders of all bytes
    "op11_spelling_variants": r"""WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY 1, 2),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM c), t),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h), v AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.k = b.k AND a.word <> b.word UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.k UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.k),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m FROM p GROUP BY 1), f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN g USING (word)),
s AS (WITH RECURSIVE s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next) SELECT word, root FROM s WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN s USING (word)""",
    "op13_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents), h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(x, 8 * k + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train_network(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = predict_language(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    out = score_toxicity(docs, train_toxicity(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    out = read_warc(spark, folder)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "byte_bpe_50k.json").drop("text")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
