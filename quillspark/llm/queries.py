"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, exact, fim, langid, mixture, pii, quality, search, secret_scan, simhash, tokens
from .common import fleeting, table


def op1_nearest(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op4_tokens(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_chat(spark: SparkSession, d: str) -> DataFrame:
    return chat.format_messages(table(spark, d, "conversations"))


def tool_links(spark: SparkSession, d: str) -> DataFrame:
    """What op5's operator links, over conversations made of the table's turns, which hold no calls of
    their own: of every conversation's messages each even turn is a call that needs the result before it,
    and each odd turn a result. Odd conversations stand in the reverse order; in every seventh the first call
    also needs the last result, which is a cycle. A call of a text with an `a` lacks an argument."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("last", F.max("turn").over(W.partitionBy("conv_id"))).where("turn <= last - (last + 1) % 2")
    call_id = lambda t: F.concat(F.lit("c"), t.cast("string"))
    end = F.col("last") - F.col("last") % 2 - F.when(F.col("last") % 2 == 0, 2).otherwise(0)
    need = F.when(F.col("turn") > 0, F.array(call_id(F.col("turn") - 2))).when((F.col("conv_id") % 7 == 0), F.array(call_id(end))).otherwise(F.array().cast("array<string>"))
    given = F.when(F.instr("text", "a") > 0, F.lit('{"n":1}')).otherwise(F.lit('{"n":1,"q":"x"}'))
    call = F.to_json(F.struct(F.array(F.struct(call_id(F.col("turn")).alias("id"), F.lit("find").alias("name"), given.alias("arguments"), need.alias("depends_on"))).alias("tool_calls")))
    result = F.to_json(F.struct(call_id(F.col("turn") - 1).alias("tool_call_id"), F.lit("done").alias("content")))
    place = F.when(F.col("conv_id") % 2 == 0, F.col("turn")).otherwise(F.col("last") - F.col("turn"))
    made = rows.select("conv_id", place.alias("turn"), F.when(F.col("turn") % 2 == 0, "assistant").otherwise("tool").alias("role"), F.when(F.col("turn") % 2 == 0, call).otherwise(result).alias("text"))
    tools = rows.where("turn = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit('{"tools":[{"name":"find","parameters":{"properties":{"n":{"type":"integer"},"q":{"type":"string"}},"required":["q"]}}]}').alias("text"))
    out = chat.format_messages(made.withColumn("turn", F.col("turn").cast("long")).union(tools))
    return out.select("conv_id", "turn", "ready", "depth", "kind", "n_calls", "problems", "cyclic")


def op6_language(spark: SparkSession, d: str) -> DataFrame:
    """Pages by text, markup, suffix and host; documents, which have no markup and no address, by
    text and the table's shares."""
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    none = F.lit(None)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), none.cast("long").alias("doc_id"), F.col("html").alias("body"), F.lit(True).alias("is_html"), F.col("url").cast("string").alias("url"))
    rows = rows.union(docs.select(none.cast("long"), F.col("doc_id").cast("long"), "text", F.lit(False), none.cast("string")))
    return langid.identify(rows, docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def op7_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op8_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Through a stored ledger, which each run begins anew, and which goes when the driver ends."""
    ledger = secret_scan.Ledger(spark, fleeting(spark))
    return secret_scan.digest(ledger.findings(table(spark, d, "documents"))[0])


def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, d, "documents")))


def op10_mixture(spark: SparkSession, d: str) -> DataFrame:
    out = mixture.allocate(table(spark, d, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_middle(spark: SparkSession, d: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, d, "documents").select("doc_id", "text")))


def op12_ranked(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_copies(spark: SparkSession, d: str) -> DataFrame:
    return exact.copies(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_nearest, op2_quality, op3_simhash, op4_tokens, op5_chat, tool_links, op6_language, op7_decontaminate, op8_secrets, op9_pii, op10_mixture, op11_middle, op12_ranked, op13_copies)}


_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS shuffle
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS most, row_number() OVER (ORDER BY source NULLS LAST) AS place,
             [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM w),
l AS (SELECT *, (budget - CAST(coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
             / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM r),
t AS (SELECT source, source_size, budget, least(CAST(most AS DOUBLE), coalesce(weight * (SELECT arg_min(lev, ratio) FROM l WHERE ratio > lev), most)) AS target FROM l),
q AS (SELECT row_number() OVER (ORDER BY d.source NULLS LAST, d.shuffle, d.size) AS place, d.doc_id, d.source, d.size, t.source_size, t.target, t.budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT place, source, target, budget, start + copy * source_size AS start,
             least(size, CAST(floor(target) AS BIGINT) - (start + copy * source_size)) AS words
      FROM q, (VALUES (0), (1)) AS copies(copy)
      WHERE least(size, CAST(floor(target) AS BIGINT) - (start + copy * source_size)) > 0),
o AS (SELECT place, words, CAST(floor(budget) AS BIGINT)
             - (CAST(sum(words) OVER (ORDER BY CAST(start + words AS DOUBLE) / target, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - words) AS remaining
      FROM c),
g AS (SELECT place, sum(greatest(0, least(words, remaining))) AS taken FROM o GROUP BY place)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g ON q.place = g.place
"""

#: The tables' messages hold no tool calls, so each stands for itself.
_OP5 = r"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(turn AS BIGINT) AS ready, CAST(0 AS BIGINT) AS depth,
       'message' AS kind, 0 AS n_calls, CAST([] AS VARCHAR[]) AS problems, false AS cyclic, m AS message,
       '<|im_start|>' || role || chr(10) || m || '<|im_end|>' || chr(10) AS formatted
FROM (SELECT conv_id, turn, lower(trim(coalesce(role, ''))) AS role,
             CAST(to_json({'content': coalesce(text, ''), 'role': lower(trim(coalesce(role, '')))}) AS VARCHAR) AS m
      FROM conversations)
"""


_TOOL_LINKS = r"""
WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN conv_id % 2 = 0 THEN turn ELSE last - turn END AS place
      FROM m WHERE turn <= last - (last + 1) % 2)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(place AS BIGINT) AS turn,
       CAST(CASE WHEN conv_id % 7 = 0 OR conv_id % 2 = 0 THEN place ELSE last END AS BIGINT) AS ready,
       CAST(CASE WHEN conv_id % 7 = 0 THEN 0 ELSE turn END AS BIGINT) AS depth,
       CASE WHEN turn % 2 = 0 THEN 'calls' ELSE 'result' END AS kind, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_calls,
       CASE WHEN turn % 2 = 0 AND contains(text, 'a') THEN ['missing q'] ELSE CAST([] AS VARCHAR[]) END AS problems,
       conv_id % 7 = 0 AS cyclic
FROM r
UNION ALL
SELECT CAST(conv_id AS BIGINT), -1, -1, 0, 'message', 0, CAST([] AS VARCHAR[]), false FROM r WHERE turn = 0
"""


_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM g),
x AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
k AS (SELECT place, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM k),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
t AS (SELECT place, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT place, unnest(terms) AS term FROM k) WHERE term IN (SELECT term FROM q) GROUP BY place, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, docs),
i AS (SELECT t.place, t.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS impact
      FROM t JOIN f USING (term) JOIN k USING (place), s),
r AS (SELECT item_id, place, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, place),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM r JOIN k USING (place) WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""

_OP13 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_middle": _OP11, "op12_ranked": _OP12, "op13_copies": _OP13, "tool_links": _TOOL_LINKS, "op5_chat": _OP5, "op10_mixture": _OP10}
