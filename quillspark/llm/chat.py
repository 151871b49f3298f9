"""Chat formatting with tool-call linking, in DataFrame operations alone.

Messages are rows. An assistant's text that is a JSON object with `tool_calls` (id, name,
arguments, and depends_on: ids whose results it needs) makes calls; a tool's text that is an object
with `tool_call_id` is a result; a system text with `tools` declares schemas. Calls and results are
joined by conversation and identifier, ordered topologically, arguments are held against the
schemas, and each message is written as canonical JSON: keys in order, no blanks.

Nothing gathers a conversation: a message's place is the sort key (ready, depth, turn) of its own
row, so one conversation may hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
_RESULT = "tool_call_id string, content string"
_TOOLS = "tools array<struct<name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>>>"

#: The kinds that a schema may name, by what a value's own kind is.
_FITS = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}


def _canonical(text):
    """Keys in order, no blanks; null where it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, node, calls, result, tools): what each message holds; null where it
    holds none. node tells apart messages of one turn."""
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.lower(F.trim(F.coalesce(F.col(role_col), F.lit("")))).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    is_json = F.ltrim("text").startswith("{")
    read = lambda role, schema: F.when((F.col("role") == role) & is_json & F.try_parse_json("text").isNotNull(), F.from_json("text", schema))
    rows = rows.withColumn("node", F.xxhash64("role", "text"))
    rows = rows.withColumn("calls", read("assistant", _CALLS)["tool_calls"])
    rows = rows.withColumn("calls", F.when(F.size("calls") > 0, F.filter("calls", lambda c: c.isNotNull())))
    result = read("tool", _RESULT)
    rows = rows.withColumn("result", F.when(result["tool_call_id"].isNotNull(), result))
    return rows.withColumn("tools", read("system", _TOOLS)["tools"])


def check_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (conv, turn, node, id, name, arguments, ...) with problems array<string>: why a call's
    arguments do not fit the schema that its conversation declares for the tool; empty where they do.
    """
    schema = tools.groupBy("conv", "name").agg(F.min_by("parameters", F.struct("turn", "node")).alias("parameters"))
    schema = schema.select(F.col("conv").alias("sc"), F.col("name").alias("sn"), "parameters")
    rows = calls.join(schema, F.col("conv").eqNullSafe(F.col("sc")) & (F.col("name") == F.col("sn")), "left")
    v = F.try_parse_json("arguments")
    fields = F.expr("try_cast(try_parse_json(arguments) as map<string,variant>)")
    rows = rows.withColumn("fields", F.when(F.schema_of_variant(v).startswith("OBJECT"), fields))
    given = F.map_keys("fields")
    props = F.coalesce(F.col("parameters.properties"), F.create_map().cast("map<string,struct<type:string>>"))
    rows = rows.withColumn("props", props)
    wanted = F.col("props")
    types = lambda k: F.regexp_extract(F.schema_of_variant(F.element_at("fields", k)), r"^([A-Z]+)", 1)
    expect = lambda k: F.element_at(wanted, k)["type"]
    fits = lambda k: F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for name, kinds in _FITS.items() for x in (F.lit(name), F.array(*map(F.lit, kinds)))]), expect(k)), types(k)), F.lit(True))
    none = F.array().cast("array<string>")
    problems = F.when(F.col("sn").isNull(), F.array(F.lit("unknown tool"))).when(
        F.col("fields").isNull(), F.array(F.lit("arguments are no object"))
    ).otherwise(F.concat(
        F.transform(F.array_sort(F.array_except(F.coalesce(F.col("parameters.required"), none), given)), lambda k: F.concat(F.lit("missing "), k)),
        F.transform(F.array_sort(F.array_except(given, F.map_keys(wanted))), lambda k: F.concat(F.lit("unknown "), k)),
        F.transform(F.array_sort(F.filter(F.array_intersect(given, F.map_keys(wanted)), lambda k: ~fits(k))), lambda k: F.concat(F.lit("wrong kind "), k)),
    ))
    return rows.withColumn("problems", problems).drop("sc", "sn", "parameters", "fields", "props")


#: Conversations of so many edges at most, and of so many that lead back in turn, are ordered in one row.
FOLD_EDGES, FOLD_BACK = 1024, 16


def topological(nodes_edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(conv, node, turn, ready long, depth long, cyclic boolean) of every end of the edges
    (conv, a_node, a_turn, b_node, b_turn), a before b.

    A message is placed once all before it are. depth is the longest way to it, ready the latest turn
    on any way to it; messages on or behind a cycle are never placed, and keep their turn. Sorting by
    (ready, depth, turn) puts every placed message behind what it needs.

    A conversation of few edges (FOLD_EDGES, a bound on what is gathered) is folded in its row, see
    _folded(); others, and those with a cycle, go through Kahn's rounds over the whole table, where
    chains deeper than `max_depth` raise a RuntimeError.
    """
    edges = stored(nodes_edges.distinct())
    back = F.coalesce(F.col("a_turn") >= F.col("b_turn"), F.lit(True))
    sizes = edges.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n"), F.count_if(back).alias("back"))
    small = sizes.where((F.col("n") <= FOLD_EDGES) & (F.col("back") <= FOLD_BACK)).select("c")
    own = F.col("conv").eqNullSafe(F.col("c"))
    folded = stored(_folded(edges.join(small, own, "left_semi")))
    settled = folded.where("settled").select(F.col("conv").alias("c"))
    rest = _rounds(stored(edges.join(settled, own, "left_anti")), max_depth)
    # Each list once: the exploded places are the conversation's messages.
    placed = folded.where("settled").select("conv", F.explode("places").alias("p")).select("conv", "p.node", "p.turn", "p.ready", "p.depth", F.lit(False).alias("cyclic"))
    return placed.union(rest)


def _folded(edges: DataFrame) -> DataFrame:
    """(conv, places array of (node, turn, ready, depth), settled) of each conversation: its messages
    in order of turn, edges swept in order of the message that they lead to until nothing changes.

    One sweep places all that edges onward in turn reach, and each edge back in turn asks for one more
    at most; what has not settled by then has a cycle.
    """
    conv = edges.groupBy("conv").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct(F.col("a_turn").alias("turn"), F.col("a_node").alias("node")), F.struct(F.col("b_turn").alias("turn"), F.col("b_node").alias("node"))))))).alias("at"),
        F.collect_list(F.struct(F.struct(F.col("a_turn").alias("turn"), F.col("a_node").alias("node")).alias("a"), F.struct(F.col("b_turn").alias("turn"), F.col("b_node").alias("node")).alias("b"))).alias("own"),
    )
    conv = conv.withColumn("own", F.array_sort(F.transform("own", lambda e: F.struct(F.array_position("at", e.b).alias("b"), F.array_position("at", e.a).alias("a")))))
    start = F.struct(F.transform("at", lambda x: x.turn).alias("ready"), F.transform("at", lambda x: F.lit(0).cast("long")).alias("depth"), F.lit(True).alias("changed"))

    def step(s, e):
        ready, depth = F.element_at(s.ready, e.a.cast("int")), F.element_at(s.depth, e.a.cast("int")) + 1
        later, deeper = ready > F.element_at(s.ready, e.b.cast("int")), depth > F.element_at(s.depth, e.b.cast("int"))
        put = lambda values, v, more: F.when(more, F.transform(values, lambda x, i: F.when(i + 1 == e.b, v).otherwise(x))).otherwise(values)
        later, deeper = F.coalesce(later, F.lit(False)), F.coalesce(deeper, F.lit(False))
        return F.struct(put(s.ready, ready, later).alias("ready"), put(s.depth, depth, deeper).alias("depth"), (s.changed | later | deeper).alias("changed"))

    fresh = lambda s: F.struct(s.ready.alias("ready"), s.depth.alias("depth"), F.lit(False).alias("changed"))
    back = F.size(F.filter("own", lambda e: e.a >= e.b))
    swept = F.aggregate(F.sequence(F.lit(0), back + 1), start, lambda s, _: F.when(s.changed, F.aggregate("own", fresh(s), step)).otherwise(s))
    conv = conv.withColumn("s", swept)
    places = F.transform(F.arrays_zip("at", F.col("s.ready"), F.col("s.depth")), lambda z: F.struct(z["at"].node.alias("node"), z["at"].turn.alias("turn"), z["ready"].alias("ready"), z["depth"].alias("depth")))
    return conv.select("conv", places.alias("places"), (~F.col("s.changed")).alias("settled"))


def _rounds(edges: DataFrame, max_depth: int) -> DataFrame:
    """topological() of stored edges by Kahn's rounds."""
    if edges.isEmpty():
        return edges.select("conv", F.col("a_node").alias("node"), F.col("a_turn").alias("turn"), F.col("a_turn").alias("ready"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    ends = edges.select("conv", F.col("a_node").alias("node"), F.col("a_turn").alias("turn")).union(edges.select("conv", F.col("b_node").alias("node"), F.col("b_turn").alias("turn"))).distinct()
    state = stored(ends.withColumn("ready", F.col("turn")).withColumn("depth", F.lit(0).cast("long")))
    done, left = None, edges
    key = lambda a, b, n: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.node") == F.col(f"{b}.{n}_node")) & F.col(f"{a}.turn").eqNullSafe(F.col(f"{b}.{n}_turn"))
    for number in range(max_depth):
        free = stored(state.alias("s").join(left.alias("e"), key("s", "e", "b"), "left_anti"))
        if free.isEmpty():
            break
        done = free if done is None else stored(done.union(free)) if number % 16 == 15 else done.union(free)
        out = left.alias("e").join(free.alias("s"), key("s", "e", "a")).groupBy(F.col("e.conv").alias("conv"), F.col("b_node").alias("node"), F.col("b_turn").alias("turn")).agg(F.max("ready").alias("r"), (F.max("depth") + 1).alias("d"))
        rest = state.alias("s").join(left.alias("e"), key("s", "e", "b"), "left_semi")
        same = F.col("s.conv").eqNullSafe(F.col("o.conv")) & (F.col("s.node") == F.col("o.node")) & F.col("s.turn").eqNullSafe(F.col("o.turn"))
        state = stored(rest.alias("s").join(out.alias("o"), same, "left").select("s.conv", "s.node", "s.turn", F.greatest("ready", "r").alias("ready"), F.greatest("depth", "d").alias("depth")))
        left = stored(left.alias("e").join(free.alias("s"), key("s", "e", "a"), "left_anti"))
    else:
        if not state.alias("s").join(left.alias("e"), key("s", "e", "b"), "left_anti").isEmpty():
            raise RuntimeError(f"messages depend on each other more than {max_depth} deep")
    placed = state.limit(0) if done is None else done
    stuck = state if done is None else state.alias("s").join(done.alias("o"), F.col("s.conv").eqNullSafe(F.col("o.conv")) & (F.col("s.node") == F.col("o.node")) & F.col("s.turn").eqNullSafe(F.col("o.turn")), "left_anti")
    return placed.withColumn("cyclic", F.lit(False)).union(stuck.select("conv", "node", "turn", F.col("turn").alias("ready"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("cyclic")))


def format_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for every row of messages: (conv_id long, turn long, ready long, depth long, kind
    string, n_calls int, problems array<string>, cyclic boolean, message string, formatted string).

    kind: message, calls, result, or orphan where a result's call is not in the conversation. Of
    calls with one identifier in a conversation the first counts. message is the canonical JSON,
    formatted the same in the turn markers of a chat template. A null text counts as empty and a
    null role as no role; text that is not the JSON looked for is content as it stands. Null
    conversations link within themselves; rows that repeat each stay. Order the messages of a
    conversation by (ready, depth, turn). Other columns are not read.
    """
    rows = stored(parse(messages, conv_col, turn_col, role_col, text_col))
    holder = rows.where("calls is not null").dropDuplicates(["conv", "turn", "node"])
    calls = holder.select("conv", "turn", "node", F.posexplode("calls").alias("place", "c")).select("conv", "turn", "node", "place", "c.*")
    tools = rows.where("tools is not null").select("conv", "turn", "node", F.explode("tools").alias("t")).select("conv", "turn", "node", "t.*").where("name is not null")
    calls = stored(check_arguments(calls, tools))
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min_by(F.struct("turn", "node", "name"), F.struct("turn", "node", "place")).alias("call"))
    first = first.select(F.col("conv").alias("fc"), F.col("id").alias("fid"), "call")
    results = rows.where("result is not null").select("conv", "turn", "node", F.col("result.tool_call_id").alias("rid")).distinct()
    linked = stored(results.hint("shuffle_hash").join(first, F.col("conv").eqNullSafe(F.col("fc")) & (F.col("rid") == F.col("fid"))).select("conv", "turn", "node", "rid", "call"))
    edges = linked.select("conv", F.col("call.node").alias("a_node"), F.col("call.turn").alias("a_turn"), F.col("node").alias("b_node"), F.col("turn").alias("b_turn"))
    needs = calls.select("conv", "turn", "node", F.explode("depends_on").alias("need"))
    given = linked.select(F.col("conv").alias("lc"), "rid", F.col("turn").alias("a_turn"), F.col("node").alias("a_node"))
    edges = edges.union(needs.join(given, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("need") == F.col("rid"))).select("conv", "a_node", "a_turn", F.col("node").alias("b_node"), F.col("turn").alias("b_turn")))
    order = topological(edges).select(F.col("conv").alias("oc"), F.col("node").alias("on"), F.col("turn").alias("ot"), "ready", "depth", "cyclic")
    one = F.concat(
        F.lit('{"arguments":'), F.coalesce(_canonical(F.col("arguments")), F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("v")))) - 6)),
        F.regexp_replace(F.to_json(F.struct(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"))), r"^\{", ","),
    )
    shown = calls.groupBy("conv", "turn", "node").agg(
        F.array_sort(F.collect_list(F.struct("place", one.alias("json"), "problems"))).alias("all")
    ).select(F.col("conv").alias("cc"), F.col("turn").alias("ct"), F.col("node").alias("cn"), F.transform("all", lambda x: x.json).alias("jsons"), F.flatten(F.transform("all", lambda x: x.problems)).alias("problems"))
    names = linked.select(F.col("conv").alias("nc"), F.col("turn").alias("nt"), F.col("node").alias("nn"), F.coalesce(F.col("call.name"), F.lit("")).alias("called"))
    at = lambda c, t, n: F.col("conv").eqNullSafe(F.col(c)) & F.col("turn").eqNullSafe(F.col(t)) & (F.col("node") == F.col(n))
    # Only messages with calls, results or links are joined; the others pass by.
    special = rows.where("calls is not null or result is not null")
    plain = rows.where("calls is null and result is null")
    out = special.join(order, at("oc", "ot", "on"), "left").join(shown, at("cc", "ct", "cn"), "left").join(names, at("nc", "nt", "nn"), "left")
    text = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    content = F.coalesce(F.col("result.content"), F.lit(""))
    message = F.when(F.col("calls").isNotNull(), F.concat(F.lit('{"role":"assistant","tool_calls":['), F.array_join(F.coalesce("jsons", F.array().cast("array<string>")), ","), F.lit("]}"))).when(
        F.col("called").isNotNull(), text(content=content, name=F.col("called"), role=F.col("role"), tool_call_id=F.col("result.tool_call_id"))
    ).otherwise(text(content=content, role=F.col("role"), tool_call_id=F.col("result.tool_call_id")))
    kind = F.when(F.col("calls").isNotNull(), "calls").when(F.col("called").isNotNull(), "result").otherwise("orphan")
    none = F.array().cast("array<string>")
    out = out.select("conv", "turn", "role", F.coalesce("ready", "turn").alias("ready"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), kind.alias("kind"), F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"), F.coalesce("problems", none).alias("problems"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), message.alias("message"))
    plain = plain.select("conv", "turn", "role", F.col("turn").alias("ready"), F.lit(0).cast("long").alias("depth"), F.lit("message").alias("kind"), F.lit(0).alias("n_calls"), none.alias("problems"), F.lit(False).alias("cyclic"), text(content=F.col("text"), role=F.col("role")).alias("message"))
    out = out.unionByName(plain)
    formatted = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("message"), F.lit("<|im_end|>\n"))
    return out.select(F.col("conv").alias("conv_id"), "turn", "ready", "depth", "kind", F.when(F.col("n_calls") < 0, 0).otherwise(F.col("n_calls")).alias("n_calls"), "problems", "cyclic", "message", formatted.alias("formatted"))
