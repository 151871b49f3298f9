"""Queries of labels, transcripts, distances and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import grammar, scoring, signal
from ..session import table

def _names(s, d) -> DataFrame:
    """An encoded file name for each part: letters by its keys."""
    k = F.col("p_partkey")
    letter = lambda n: F.substring(F.lit("0123456789ZO"), (F.pmod(k * n, F.lit(12)) + 1).cast("int"), F.lit(1))
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("FBH_"), letter(1), letter(5), letter(7), F.lit("A")).alias("name"))


_NAMES = "nm AS (SELECT p_partkey, 'FBH_' || substr('0123456789ZO', CAST(p_partkey % 12 AS BIGINT) + 1, 1) || substr('0123456789ZO', CAST(p_partkey * 5 % 12 AS BIGINT) + 1, 1) || substr('0123456789ZO', CAST(p_partkey * 7 % 12 AS BIGINT) + 1, 1) || 'A' AS name FROM part)"


def _pairs(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", (F.col("event_id") % 1000).cast("string").alias("result"), (F.col("event_id") * 7 % 1000).cast("string").alias("label"))


_PAIRS = "pr AS (SELECT event_id, CAST(event_id % 1000 AS VARCHAR) AS result, CAST(event_id * 7 % 1000 AS VARCHAR) AS label FROM events)"
_HITS = "CASE WHEN length(result) = length(label) THEN len(list_filter(range(1, length(label) + 1), lambda i: substr(result, i, 1) = substr(label, i, 1))) ELSE 0 END"
_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh", "none")


def _transcripts(s, d) -> DataFrame:
    """A line of spoken digits and a file name for each event."""
    e, w = F.col("event_id"), F.array(*map(F.lit, _WORDS[:11]))
    word = lambda n: F.element_at(w, (F.pmod(e * n, F.lit(11)) + 1).cast("int"))
    return table(s, d, "events").select("event_id", F.concat_ws(" ", word(1), word(3), F.concat(F.lit("("), F.lit("f"), F.col("user_id").cast("string"), F.lit("_"), e.cast("string"), F.lit(")"))).alias("value"))


def _digits(s, d) -> DataFrame:
    words = F.filter(F.split("value", " "), lambda x: ~x.startswith("("))
    return _transcripts(s, d).select("event_id", F.transform(words, lambda x: C.word_to_digit(x)).alias("digits"), F.regexp_extract("value", r"\(([^)]*)\)$", 1).alias("file"))


_DIG = "dg AS (SELECT event_id, [CAST(event_id % 11 AS INTEGER), CAST(event_id * 3 % 11 AS INTEGER)] AS digits, 'f' || user_id || '_' || event_id AS file FROM events)"
_EDGES = "edges AS (SELECT * FROM (SELECT CAST(user_id AS INTEGER) AS src, CAST(lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS dst, CASE WHEN event_id % 3 <> 0 THEN event_type END AS word FROM events) WHERE dst IS NOT NULL)"


def _lines(s, d) -> DataFrame:
    """A grammar's lines, in which users follow one another by `events` of a type: two of three events say
    it, some with the stray quote that such files hold, and the last of a type is no edge."""
    rows = signal.sequence_index(table(s, d, "events"), "event_type", ["ts", "event_id"], "ts", "day")
    after = rows.select("event_type", (F.col("i") - 1).alias("i"), F.col("user_id").alias("dst"))
    word = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(' "'), "event_type", F.when(F.col("event_id") % 5 == 1, '""').otherwise('"'))).otherwise("")
    line = F.when(F.col("dst").isNull(), "Terminal_States: 3").otherwise(F.concat(F.lit("Edge "), F.col("user_id").cast("string"), F.lit(" "), F.col("dst").cast("string"), word))
    return rows.join(after, ["event_type", "i"], "left").select(line.alias("value"))


def _text(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text, so that rows compare by value."""
    return df.withColumns({n: F.concat_ws(",", F.transform(n, lambda x: x.cast("string"))) for n in names})


def _roles(s, d) -> DataFrame:
    """The roles of each conversation, in order of turn, as labels; silence on both sides."""
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("label"))
    return rows


_ROLES = "rl AS (SELECT conv_id, list(role ORDER BY turn, role) AS label FROM conversations GROUP BY conv_id)"


def queries() -> dict:
    return {
        "filename_label": lambda s, d: _text(_names(s, d).select("p_partkey", C.filename_label(F.col("name")).alias("label")), "label"),
        "same_start": lambda s, d: table(s, d, "part").select("p_partkey", C.same_start(F.col("p_name"), F.col("p_type")).alias("same")),
        "transcript_digits": lambda s, d: _text(_digits(s, d), "digits"),
        "digit_count": lambda s, d: scoring.digit_counts(_digits(s, d)),
        "files_by_sequence": lambda s, d: _text(scoring.by_sequence(_text(_digits(s, d), "digits")), "files"),
        "with_digit": lambda s, d: _text(_digits(s, d).where(F.array_contains("digits", 7)).select("event_id", "digits"), "digits"),
        "edit_distance": lambda s, d: table(s, d, "part").select("p_partkey", C.edit_distance(F.col("p_brand"), F.col("p_type")).cast("int").alias("distance"), C.edit_distance(F.col("p_brand"), F.col("p_type"), True).cast("int").alias("whole_string")),
        "word_accuracy": lambda s, d: scoring.accuracy(_pairs(s, d)).select("words_right", "words", F.round("word_accuracy", 6).alias("word_accuracy")),
        "sentence_accuracy": lambda s, d: scoring.accuracy(_pairs(s, d)).select("sentences_right", "sentences", F.round("sentence_accuracy", 6).alias("sentence_accuracy")),
        "sentence_hits": lambda s, d: _pairs(s, d).select("event_id", scoring.word_hits(F.col("result"), F.col("label")).cast("int").alias("hits")),
        "exact_match": lambda s, d: _pairs(s, d).agg(F.round(F.avg((F.col("result") == F.col("label")).cast("int")), 6).alias("exact")),
        "silence_affix": lambda s, d: _text(_roles(s, d).select("conv_id", C.with_silence(F.col("label")).alias("label")), "label"),
        "silence_removed": lambda s, d: _text(_roles(s, d).select("conv_id", C.without_silence(C.with_silence(F.col("label"))).alias("label")), "label"),
        "boundary_offsets": lambda s, d: _text(_roles(s, d).select("conv_id", C.boundary_offsets(C.with_silence(F.col("label")), F.lit("sil")).alias("starts")), "starts"),
        "template_concat": lambda s, d: _text(_roles(s, d).select("conv_id", C.template_concat(F.col("label"), F.create_map(F.lit("user"), F.array(F.lit("u0"), F.lit("u1")), F.lit("assistant"), F.array(F.lit("a0")), F.lit("system"), F.array(F.lit("s0"), F.lit("s1")))).alias("states")), "states"),
        "reversed_labels": lambda s, d: _text(_roles(s, d).select("conv_id", F.reverse("label").alias("label")), "label"),
        "base_name": lambda s, d: table(s, d, "pages").select("page_id", C.base_name(F.col("url")).alias("base")),
        "quoted_digit": lambda s, d: table(s, d, "events").select("event_id", C.quoted_digit(F.col("props")).alias("letter")),
        "grammar_edges": lambda s, d: grammar.parse(_lines(s, d)),
        "grammar_reach": lambda s, d: grammar.reachable(grammar.parse(_lines(s, d)), 3),
        "positional_join": lambda s, d: _positional(s, d),
    }


def _positional(s, d) -> DataFrame:
    """Orders beside customers of the same place in key order, both ranked by key."""
    from ..operators.relational import ranked

    a = ranked(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "idx")
    b = ranked(table(s, d, "customer").select("c_custkey"), ["c_custkey"], "idx")
    return scoring.by_position(a.join(b.select("idx"), "idx", "left_semi"), b, "idx").select("idx", "o_orderkey", "c_custkey")


def oracle_sql() -> dict[str, str]:
    return {
        "filename_label": f"WITH {_NAMES} SELECT p_partkey, '10,' || array_to_string(list_transform(list_filter(range(5, 8), lambda i: true), lambda i: CASE substr(name, i, 1) WHEN 'Z' THEN '0' WHEN 'O' THEN '11' ELSE substr(name, i, 1) END), ',') AS label FROM nm",
        "same_start": "SELECT p_partkey, substr(p_name, 1, 3) = substr(p_type, 1, 3) AS same FROM part",
        "transcript_digits": f"WITH {_DIG} SELECT event_id, array_to_string(digits, ',') AS digits, file FROM dg",
        "digit_count": f"WITH {_DIG} SELECT digit, count(*) AS n FROM (SELECT unnest(digits) AS digit FROM dg) GROUP BY digit",
        "files_by_sequence": f"WITH {_DIG} SELECT array_to_string(digits, ',') AS digits, array_to_string(list(file ORDER BY file), ',') AS files FROM dg GROUP BY 1",
        "with_digit": f"WITH {_DIG} SELECT event_id, array_to_string(digits, ',') AS digits FROM dg WHERE list_contains(digits, 7)",
        "edit_distance": "SELECT p_partkey, CAST(levenshtein(p_brand, p_type) AS INTEGER) AS distance, CAST(greatest(length(p_brand), length(p_type)) AS INTEGER) AS whole_string FROM part",
        "word_accuracy": f"WITH {_PAIRS} SELECT CAST(sum({_HITS}) AS BIGINT) AS words_right, CAST(sum(length(label)) AS BIGINT) AS words, round(sum({_HITS}) / sum(length(label)), 6) AS word_accuracy FROM pr",
        "sentence_accuracy": f"WITH {_PAIRS} SELECT CAST(count(*) FILTER (result = label) AS BIGINT) AS sentences_right, count(*) AS sentences, round(count(*) FILTER (result = label) / count(*), 6) AS sentence_accuracy FROM pr",
        "sentence_hits": f"WITH {_PAIRS} SELECT event_id, CAST({_HITS} AS INTEGER) AS hits FROM pr",
        "exact_match": f"WITH {_PAIRS} SELECT round(avg(CAST(result = label AS INTEGER)), 6) AS exact FROM pr",
        "silence_affix": f"WITH {_ROLES} SELECT conv_id, 'sil,' || array_to_string(label, ',') || ',sil' AS label FROM rl",
        "silence_removed": f"WITH {_ROLES} SELECT conv_id, array_to_string(label, ',') AS label FROM rl",
        "boundary_offsets": f"WITH {_ROLES} SELECT conv_id, '0,' || array_to_string(list_transform(range(0, len(label) + 1), lambda i: 2 + 5 * i), ',') AS starts FROM rl",
        "template_concat": f"WITH {_ROLES} SELECT conv_id, array_to_string(list_transform(label, lambda r: CASE r WHEN 'user' THEN 'u0,u1' WHEN 'assistant' THEN 'a0' ELSE 's0,s1' END), ',') AS states FROM rl",
        "reversed_labels": f"WITH {_ROLES} SELECT conv_id, array_to_string(list_reverse(label), ',') AS label FROM rl",
        "base_name": r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS base FROM pages",
        "quoted_digit": """SELECT event_id, regexp_extract(props, '"(.)', 1) AS letter FROM events""",
        "grammar_edges": f"WITH {_EDGES} SELECT src, dst, word FROM edges",
        "grammar_reach": f"WITH RECURSIVE {_EDGES}, moves AS (SELECT DISTINCT src, dst FROM edges), w(state, steps) AS (SELECT 3, 0 UNION SELECT e.dst, w.steps + 1 FROM w JOIN moves e ON e.src = w.state WHERE w.steps < 20) SELECT CAST(state AS INTEGER) AS state, CAST(min(steps) AS INTEGER) AS steps FROM w GROUP BY state",
        "positional_join": "SELECT idx, o_orderkey, c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) USING (idx)",
    }
