"""Tool calls of chats: linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join by conversation and identifier. A call comes after the calls it
names in `after`. Transcripts are mostly in such an order already, so a call keeps its place unless
something it needs stands later; then it moves behind the last call that it needs, directly or not.
Both the moves and the order among calls that moved to one place are found for whole tables at a time,
so that a conversation with very many calls is not one task, and by jumps whose reach doubles, so that
a long chain of calls takes few rounds. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, materialise

MESSAGE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>"


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text).

    An assistant's text that is JSON with tool_calls holds calls (id, name, arguments as JSON text or
    object, after); a tool's text that is JSON with tool_call_id and content holds a result. Other
    messages, null ones too, hold none.
    """
    body = messages.withColumn("m_", F.from_json("text", MESSAGE))
    calls = body.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("m_.tool_calls").alias("n", "c"))
    calls = calls.select("conv_id", "turn", "n", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = body.filter("role = 'tool' and m_.tool_call_id is not null").select("conv_id", "turn", F.col("m_.tool_call_id").alias("call_id"), F.col("m_.content").alias("content"))
    return calls, results


def _errors(arguments: Column, params: Column, known: Column) -> Column:
    """What is wrong with parsed arguments by the parameters (name, type, required, options) of a tool."""
    entries = F.map_entries(F.try_variant_get(arguments, "$", "map<string,variant>"))

    def type_ok(value: Column, want: Column) -> Column:
        kind = F.schema_of_variant(value)
        whole = kind == "BIGINT"
        number = whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        of = {"string": kind == "STRING", "integer": whole, "number": number, "boolean": kind == "BOOLEAN", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"), "null": kind == "VOID"}
        out = F.lit(True)
        for name, ok in of.items():
            out = F.when(want == name, ok).otherwise(out)
        return out

    def against(args: Column) -> Column:
        missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.exists(args, lambda e: e["key"] == p["name"])), lambda p: F.concat(F.lit("missing: "), p["name"]))
        unknown = F.transform(F.filter(args, lambda e: ~F.exists(params, lambda p: p["name"] == e["key"])), lambda e: F.concat(F.lit("unknown: "), e["key"]))
        mistyped = F.transform(F.filter(args, lambda e: F.exists(params, lambda p: (p["name"] == e["key"]) & ~type_ok(e["value"], p["type"]))), lambda e: F.concat(F.lit("type: "), e["key"]))
        unlisted = F.transform(
            F.filter(args, lambda e: F.exists(params, lambda p: (p["name"] == e["key"]) & (F.size(p["options"]) > 0) & ~F.coalesce(F.array_contains(p["options"], F.try_variant_get(e["value"], "$", "string")), F.lit(False)))),
            lambda e: F.concat(F.lit("option: "), e["key"]),
        )
        return F.array_sort(F.concat(missing, unknown, mistyped, unlisted))

    one = lambda text: F.array(F.lit(text))
    return F.when(~known, one("no such tool")).when(arguments.isNull(), one("not JSON")).otherwise(let(entries, lambda a: F.when(a.isNull(), one("not an object")).otherwise(against(a))))


def _places(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, step, cyclic) of calls that must move: the place they move to, their order there, and whether they need themselves or must move behind a call that does; such calls have no step.

    calls: (conv_id, call_id, at, after), ids unique. at is the call's own place, comparable in its
    conversation. A step is one more than the largest step of what a call needs among those that moved
    to the same place.
    """
    key = ["conv_id", "call_id"]
    calls = calls.filter("conv_id is not null and call_id is not null")
    needs = calls.select(*key, "at", F.explode(F.array_distinct("after")).alias("need"))
    place = calls.select("conv_id", F.col("call_id").alias("need"), F.col("at").alias("n_at"))
    edges = materialise(needs.join(place, ["conv_id", "need"]).select(*key, "at", "need", "n_at"), "needs")
    best = F.max(F.struct("at", "seen")).alias("best")
    moved = edges.groupBy(*key).agg(F.first("at").alias("own"), F.max(F.struct(F.col("n_at").alias("at"), F.col("need").alias("seen"))).alias("best")).filter("best.at >= own")
    moved = materialise(moved.select(*key, "best.*"), "moved")
    mark = None
    while (now := moved.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("conv_id", "call_id", "at")).alias("x")).first()) != mark and now["n"]:
        mark = now
        known = moved.select("conv_id", F.col("call_id").alias("need"), F.col("at").alias("m_at"), F.col("seen").alias("m_seen"))
        # What needs a call that moved may have to move behind it; and behind what the call it moved to has moved to.
        later = edges.join(known, ["conv_id", "need"]).filter("m_at >= at").select(*key, F.col("m_at").alias("at"), F.col("m_seen").alias("seen"))
        jump = moved.select(*key, F.col("seen").alias("need")).join(known, ["conv_id", "need"]).select(*key, F.col("m_at").alias("at"), F.col("m_seen").alias("seen"))
        moved = materialise(moved.unionByName(later).unionByName(jump).groupBy(*key).agg(best).select(*key, "best.*"), "moved")
    moved = moved.select(*key, "at")
    group = moved.select("conv_id", F.col("call_id").alias("need"), F.col("at").alias("m_at"))
    inner = edges.drop("at").join(moved, key).join(group, ["conv_id", "need"]).filter(F.col("at") == F.col("m_at"))
    inner = materialise(inner.select(*key, "need"), "inner")
    # A call that needs one other of its place leads on to it; the others are heads, which chains end at.
    degree = inner.groupBy(*key).agg(F.count("*").alias("needs"), F.max("need").alias("to"))
    one = F.col("needs") == 1
    chains = moved.join(degree, key, "left").select(*key, "at", F.coalesce("needs", F.lit(0)).alias("needs"), F.when(one, F.col("to")).otherwise(F.col("call_id")).alias("to"), one.cast("long").alias("far"))
    chains = materialise(chains.withColumn("far", F.coalesce("far", F.lit(0).cast("long"))), "chains")
    on = lambda df: df.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("t_to"), F.col("far").alias("t_far"))
    # Chains with an end have members at every distance from it, so a round that brings none to its end leaves circles only.
    left, before = chains.filter("far > 0").count(), -1
    while left not in (0, before):
        jumped = chains.join(on(chains), ["conv_id", "to"]).select(*key, "at", "needs", F.col("t_to").alias("to"), (F.col("far") + F.col("t_far")).alias("far"), (F.col("t_far") > 0).alias("on"))
        chains = materialise(jumped, "chains")
        left, before = chains.filter("on").count(), left
    head = chains.select("conv_id", F.col("call_id").alias("to"), F.col("needs").alias("h_needs"))
    done = materialise(chains.filter("needs = 0").select(*key, F.lit(1).cast("long").alias("step")), "steps")
    # A head that needs several comes after the heads of their chains are placed: as many rounds as such calls are nested.
    wide = inner.join(chains.filter("needs > 1").select(*key), key, "left_semi")
    ends = chains.select("conv_id", F.col("call_id").alias("need"), "to", "far")
    wide = materialise(wide.join(ends, ["conv_id", "need"]).select(*key, "to", "far"), "wide")
    while not wide.isEmpty():
        known = done.select("conv_id", F.col("call_id").alias("to"), "step")
        ready = wide.join(known, ["conv_id", "to"], "left").groupBy(*key).agg(F.max(F.col("step") + F.col("far")).alias("step"), F.bool_and(F.col("step").isNotNull()).alias("all"))
        ready = materialise(ready.filter("all").select(*key, (F.col("step") + 1).alias("step")), "ready")
        if ready.isEmpty():
            break
        done, wide = materialise(done.unionByName(ready), "steps"), materialise(wide.join(ready.select(*key), key, "left_anti"), "wide")
    # What leads to no head, or to one that is never placed, is on a circle or needs one.
    found = chains.join(head, ["conv_id", "to"]).join(done.select("conv_id", F.col("call_id").alias("to"), F.col("step").alias("h_step")), ["conv_id", "to"], "left")
    step = F.when(F.col("h_needs") != 1, F.col("h_step") + F.col("far"))
    return found.select(*key, "at", step.alias("step"), step.isNull().alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """A row for each call, and for each result without one.

    calls: (conv_id, turn, n, call_id, name, arguments, after); n orders the calls of a turn, arguments
    are JSON text. results: (conv_id, turn, call_id, content). tools: (name, params), params an array of
    (name, type, required, options).

    Returns conv_id, call_id, turn, n, place, step (order by place, step, turn, n is topological),
    cyclic (the call needs itself, or must move behind one that does; it keeps its own place), status (linked, unanswered, orphan or repeated),
    n_results, errors, and message: canonical JSON, with sorted keys and no spaces, of the call and its
    first result. Of several calls of one id, equal rows too, the first is linked and the others are repeated; of
    several results the first by turn and content counts. Rows with null identifiers join nothing:
    such calls are unanswered, such results orphans. Unknown ids in after are ignored. Other columns
    have no influence; very long texts are contents like any; empty tables give what the others have.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long"), F.col("n").cast("long"), "call_id", "name", "arguments", "after")
    # Equal rows are numbered by their count, not by a window, as they may be very many.
    calls = calls.groupBy(*calls.columns).agg(F.count("*").alias("copies"))
    calls = materialise(calls.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copies"), "calls")
    own = F.struct("turn", "n")
    firsts = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "n", "name", "arguments", "after")).alias("f"))
    key = ["conv_id", "call_id"]
    moves = _places(firsts.select(*key, F.struct(F.col("f.turn"), F.col("f.n")).alias("at"), F.col("f.after").alias("after")))
    answers = results.groupBy(*key).agg(F.count("*").alias("n_results"), F.min(F.struct(F.col("turn").cast("long").alias("turn"), "content")).alias("answer"))
    same = lambda a, b: (a["conv_id"] == b["conv_id"]) & (a["call_id"] == b["call_id"])
    first = F.struct("turn", "n", "name", "arguments", "after")
    c = calls.join(firsts.withColumnsRenamed({"conv_id": "f_conv", "call_id": "f_id"}), (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_id")), "left")
    c = c.withColumn("repeated", F.coalesce((first != F.col("f")) | (F.col("copy") > 1) & F.col("f").isNotNull(), F.lit(False))).drop("copy", "f_conv", "f_id", "f")
    joined = c.join(answers, same(c, answers), "full")
    joined = joined.select(F.coalesce(c["conv_id"], answers["conv_id"]).alias("conv_id"), F.coalesce(c["call_id"], answers["call_id"]).alias("call_id"), c["name"], c["turn"], c["n"], "arguments", "repeated", "n_results", "answer")
    moves = moves.withColumnsRenamed({"conv_id": "m_conv", "call_id": "m_id", "at": "m_at"})
    joined = joined.join(moves, (F.col("conv_id") == F.col("m_conv")) & (F.col("call_id") == F.col("m_id")), "left")
    kinds = tools.groupBy("name").agg(F.first("params").alias("params")).select(F.col("name").alias("tool"), "params")
    joined = joined.join(kinds, F.col("name") == F.col("tool"), "left").withColumn("parsed", F.try_parse_json("arguments"))
    called = F.col("repeated").isNotNull()
    status = F.when(~called, "orphan").when(F.col("repeated"), "repeated").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    errors = F.when(called, _errors(F.col("parsed"), F.col("params"), F.col("tool").isNotNull()))
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")))
    arguments = F.when(F.col("parsed").isNotNull(), F.concat(F.lit('"arguments":'), F.to_json("parsed")))
    message = F.concat(F.lit("{"), F.concat_ws(",", arguments, field("id", F.col("call_id")), field("name", F.col("name")), field("result", F.when(~F.coalesce("repeated", F.lit(False)), F.col("answer.content")))), F.lit("}"))
    place = F.coalesce(F.when(F.col("cyclic"), F.lit(None)).otherwise(F.col("m_at")), F.when(called, own), F.struct(F.col("answer.turn").alias("turn"), F.lit(None).cast("long").alias("n")))
    return joined.select(
        "conv_id",
        "call_id",
        F.coalesce("turn", "answer.turn").alias("turn"),
        "n",
        place.alias("place"),
        F.coalesce("step", F.lit(0)).alias("step"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        status.alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        errors.alias("errors"),
        message.alias("message"),
    )
