"""Queries over runs and their stages, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.operators import runs as R
from akshara.plans import queries as Q

SQL: dict[str, str] = {}


def run_summaries(spark, sf_dir):
    """Articles of each language as a run: sizes, mean scores, failed gates and sources."""
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = Q.pairs(spark, sf_dir).join(docs, "doc_id")
    rows = A.with_tokens(A.coverage(rows, "body", "story"), F.concat_ws(" ", "title", F.left("body", F.lit(600))))
    rows = A.gates(rows, "title", "body", "story", ~A.relevant(strong=Q.STRONG, weak=Q.WEAK)).drop("blob", "words", "stems")
    return R.run_summary(rows, "lang").withColumnRenamed("lang", "run").drop("fact_score", "plagiarism_score")


SQL["run_summaries"] = f"""WITH g AS ({Q.SQL["grounding_gates"]}), n AS ({Q.SQL["number_coverage"]})
SELECT d.lang AS run, count(*) AS articles, round_even(avg(coverage_score), 1) AS coverage_score, round_even(avg(number_precision), 1) AS number_precision, count(*) FILTER (NOT gates_passed) AS gates_failed, count(DISTINCT coalesce(nullif(source, ''), '')) AS sources, CAST(list_sort(list(length(coalesce(text, ''))))[count(*) // 2 + 1] AS INT) AS median_body
FROM documents d JOIN g USING (doc_id) JOIN n USING (doc_id) GROUP BY 1"""


def config_differences(spark, sf_dir):
    """The newest run of each event type: what differs between their settings (props, and settings that only some kinds have)."""
    rows = Q.table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    newest = R.newest_run(rows, "event_type", "at")
    fixed = F.create_map(F.lit("mode"), F.lit("narrow"), F.lit("kind"), F.when(F.col("event_type").startswith("s"), "s").otherwise("other"))
    some = F.when(F.col("event_type").isin("click", "view"), F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    runs = newest.select("event_type", F.map_concat(F.from_json("props", "map<string,string>"), fixed, some).alias("config"))
    out = R.config_differences(runs, "event_type", "config")
    return out.select("key", F.size("settings").alias("n"), F.array_join(F.transform("settings", lambda s: F.concat(s["run"], F.lit("="), F.coalesce(s["value"], F.lit("null")))), ",").alias("settings"))


SQL["config_differences"] = """WITH r AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT event_type, 'k' AS key, json_extract_string(props, '$.k') AS value FROM r UNION ALL SELECT event_type, 'mode', 'narrow' FROM r UNION ALL SELECT event_type, 'kind', CASE WHEN starts_with(event_type, 's') THEN 's' ELSE 'other' END FROM r UNION ALL SELECT event_type, 'user', CAST(user_id AS VARCHAR) FROM r WHERE event_type IN ('click', 'view'))
SELECT key, CAST(count(*) AS INT) AS n, string_agg(event_type || '=' || coalesce(value, 'null'), ',' ORDER BY event_type) AS settings FROM c GROUP BY key HAVING count(DISTINCT coalesce(value, 'null')) > 1 OR count(*) < (SELECT count(*) FROM r)"""

#: The stages of a run and what each was made of.
STAGES = {"kept": ["documents"], "titles": ["kept"], "sources": ["titles", "labels"], "languages": ["documents"], "report": ["sources", "languages"]}


def stage_tables(spark, sf_dir, least: int) -> dict[str, DataFrame]:
    docs, labels = Q.table(spark, sf_dir, "documents"), Q.table(spark, sf_dir, "labels")
    kept = docs.where(F.length("text") >= least).select("doc_id", "source", F.left(F.substring_index("text", "\n", 1), F.lit(120)).alias("title"))
    titles = A.first_wins(kept.withColumn("k", X.normal_key(F.col("title"))), "k", ["doc_id"]).select("doc_id", "source")
    sources = titles.groupBy("source").agg(F.count("*").alias("n"))
    languages = docs.groupBy("lang").agg(F.count("*").alias("n"))
    report = languages.agg(F.sum("n").alias("n"))
    return {"documents": docs, "labels": labels, "kept": kept, "titles": titles, "sources": sources, "languages": languages, "report": report}


def stale_stages(spark, sf_dir):
    """A run over documents, then its first stage again with another rule: which stages no longer follow from their inputs."""
    before = stage_tables(spark, sf_dir, 300)
    now = R.fingerprints(before)
    seen = R.manifest(STAGES, now)
    again = R.fingerprints(before | {"kept": stage_tables(spark, sf_dir, 400)["kept"]})
    return R.stale_stages(seen, again)


SQL["stale_stages"] = """WITH RECURSIVE changed AS (SELECT (SELECT count(*) FROM documents WHERE length(text) >= 300 AND length(text) < 400) > 0 AS yes),
e(stage, input) AS (VALUES ('kept', 'documents'), ('titles', 'kept'), ('sources', 'titles'), ('sources', 'labels'), ('languages', 'documents'), ('report', 'sources'), ('report', 'languages')),
w AS (SELECT stage, input, 1 AS depth FROM e, changed WHERE yes AND input = 'kept' UNION ALL SELECT e.stage, e.input, w.depth + 1 FROM w JOIN e ON e.input = w.stage)
SELECT stage, min(input) AS because, CAST(min(depth) AS INT) AS depth FROM w GROUP BY stage"""


def table_fingerprints(spark, sf_dir):
    """Fingerprints of documents, labels and conversations, whatever the order of their rows."""
    return R.fingerprints({n: Q.table(spark, sf_dir, n) for n in ("documents", "labels", "conversations")})


def _row(*columns: str) -> str:
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns))


def _print(name: str, *columns: str) -> str:
    part = lambda k: f"CAST(coalesce(sum(CAST(CAST('0x' || substr(x, {1 + k * R.DIGITS}, {R.DIGITS}) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR)"
    return f"SELECT '{name}' AS name, count(*) || '-' || {part(0)} || '-' || {part(1)} AS fingerprint FROM (SELECT md5({_row(*columns)}) AS x FROM {name})"


SQL["table_fingerprints"] = " UNION ALL ".join((_print("documents", "doc_id", "text", "lang", "source", "n_chars"), _print("labels", "doc_id", "quality", "toxic"), _print("conversations", "conv_id", "turn", "role", "text")))

NAMES = tuple(SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
