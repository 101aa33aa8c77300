"""The registered queries of the ten operators and their SQL oracles.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import chat, decontaminate, fingerprint, language, line_dedup, near_dedup, packing, toxicity, url_filter
from weirflow.session import read_table

#: The table's words in DuckDB: A-Z lower-cased, split at the six white-space bytes.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM l WHERE len(ls) >= 3),
h AS (SELECT doc_id, pos, md5(ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3]) AS h FROM w),
r AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM h) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, pos + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o)),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT l.doc_id,
  CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(ps, i - 1)), chr(10)) END AS text,
  coalesce(len(ls), 0) AS n_lines, coalesce(len(ps), 0) AS n_removed
FROM l LEFT JOIN g USING (doc_id)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.variable_packing(read_table(spark, sf_dir, "documents"))


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_ids(read_table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_robustness(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP5_SQL = f"""
WITH dw AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
iw AS (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS sh
  FROM (SELECT item_id, ws, least(5, len(ws)) AS k FROM iw WHERE len(ws) > 0)),
d AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS sh
  FROM dw, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM i JOIN d USING (k, sh) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment
FROM p JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n
"""


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


#: Rounds after which no propagation moves more than the operator's tolerance.
OP6_SQL_ROUNDS = 100


def _op6_sql() -> str:
    """The rules by a join, the propagation by recursion, a row for each host and round."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    link = url_filter.LINK.replace("'", "''")
    rules = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in URL_RULES)
    d = url_filter.DAMPING
    parts = [
        f"rules(verdict, rule, rh, rp) AS (VALUES {rules})",
        f"p AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        "f AS (SELECT DISTINCT host, path, rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) AS k"
        " FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))",
        "j AS (SELECT page_id, html, p.host, p.path, rule, verdict AS by_rule FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) f ON f.host = p.host AND f.path = p.path)",
        "known AS (SELECT host, CAST(count(*) FILTER (by_rule = 'allow') * 2 > count(*) AS INT) AS trusted, CAST(count(*) FILTER (by_rule = 'block') * 2 > count(*) AS INT) AS blocked FROM j WHERE host <> '' GROUP BY host)",
        f"links AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {lower.format(f'unnest(regexp_extract_all(html, {chr(39)}{link}{chr(39)}, 1))')} AS dst FROM j) WHERE src <> '' AND src <> dst)",
        "s AS (SELECT host, max(trusted) AS trusted, max(blocked) AS blocked FROM (SELECT * FROM known UNION ALL SELECT dst, 0, 0 FROM links) GROUP BY host)",
        "t AS (SELECT greatest(sum(trusted), 1) AS t, greatest(sum(blocked), 1) AS b, count(*) AS n FROM s)",
        "r0 AS (SELECT host, trusted / t AS t0, blocked / b AS b0, trusted / t AS trust, blocked / b AS distrust FROM s, t)",
        "e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in FROM links)",
    ]
    parts.append(
        "x(k, host, t0, b0, trust, distrust) AS (SELECT 0, host, t0, b0, trust, distrust FROM r0 UNION ALL"
        f" SELECT k + 1, host, sum(t0), sum(b0), {1 - d} * sum(t0) + {d} * sum(tc), {1 - d} * sum(b0) + {d} * sum(bc) FROM ("
        f" SELECT k, host, t0, b0, 0.0 AS tc, 0.0 AS bc FROM x WHERE k < {OP6_SQL_ROUNDS}"
        f" UNION ALL SELECT k, dst, 0, 0, trust / n_out, 0 FROM x JOIN e ON host = src WHERE k < {OP6_SQL_ROUNDS}"
        f" UNION ALL SELECT k, src, 0, 0, 0, distrust / n_in FROM x JOIN e ON host = dst WHERE k < {OP6_SQL_ROUNDS}) GROUP BY k, host)"
    )
    bad = f"SELECT host FROM x, t WHERE k = {OP6_SQL_ROUNDS} AND distrust * n > {url_filter.LEAST} AND distrust > trust"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN ({bad}) THEN 'block' ELSE 'allow' END) AS verdict FROM j"


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out("doc_id"))
    model = language.learn(docs.filter("not held_out"))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out("doc_id"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out("doc_id"))
    model = toxicity.learn(docs.filter("not held_out"), labels)
    scored = toxicity.score(docs, model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


#: What both turns of conversation -7 say: a template without escapes can't carry it.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    turns = turns.unionByName(hard)
    chats = chat.format_chats(turns.withColumn("content", chat.text_part(F.col("text"))))
    back = chat.read_chats(chats)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>' || role || chr(10) || text || '</turn>' || chr(10))
    + 2 * length(text) - length(replace(text, '<', '')) - length(replace(text, chr(92), ''))
    + 3 * length(role) - length(replace(role, '<', '')) - length(replace(role, chr(92), '')) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_packed_ids": op3_packed_ids,
    "op4_fingerprint": op4_fingerprint,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op5_decontamination": OP5_SQL, "op6_url_filter": _op6_sql(), "op8_near_dedup": OP8_SQL, "op10_chat_format": OP10_SQL}
