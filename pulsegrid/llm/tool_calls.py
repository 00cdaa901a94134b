"""Tool-call linking; DataFrame functions only.

Calls and results are joined by conversation and identifier, calls are put in topological order of what they wait for,
arguments are checked against the tools' schemas, and each linked call is written as canonical JSON
(keys sorted, no blanks). Joins are on both, which are unique together after a pre-aggregation (map-side
first), never on the conversation alone, so one conversation may hold any share of the rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read

#: Rounds of pointer doubling: chains of up to 2**ROUNDS calls.
ROUNDS = 40
#: Conversations of up to so many calls are put in order inside of one row each; longer ones by rounds of joins.
FOLDED = 1024


def _key(name: str) -> Column:
    """A call within its conversation; as a struct, so that null conversations are equal."""
    return F.struct("conv_id", F.col(name).alias("id"))


def _waits(calls: DataFrame) -> DataFrame:
    """(call, after): each call with each other call of its conversation that it waits for, once."""
    named = [F.array("after_id")] if "after_id" in calls.columns else []
    named += [F.coalesce("after_ids", F.array().cast("array<string>"))] if "after_ids" in calls.columns else []
    each = calls.where("call_id IS NOT NULL").select("conv_id", "call_id", F.explode(F.concat(*named)).alias("after")).where("after IS NOT NULL")
    each = each.select(_key("call_id").alias("call"), _key("after").alias("after")).distinct()
    return each.join(calls.select(_key("call_id").alias("after")), "after", "left_semi")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, and after_id or after_ids, an array, or both), call_id unique in
    a conversation: 0 where a call waits for none that exists there, else one more than the highest level that it waits for,
    so that ascending levels are a topological order. A call that waits for itself by way of others has a null level.

    Conversations of up to FOLDED calls are solved in one row each. In longer ones calls that wait for one other form chains:
    pointer doubling follows each to its anchor, a call that waits for none or for several; its rounds grow as the logarithm of the longest
    chain. Then anchors are solved from the bottom, in as many rounds as there are calls that wait for several on one path. Each
    round is written to the shared folder. Rows with a null call_id are left out, rows that repeat count once, an empty table gives an empty result.
    """
    work = Workspace(calls.sparkSession)
    waits = work.save(_waits(calls))
    ids = work.save(calls.where("call_id IS NOT NULL").select(_key("call_id").alias("call")).distinct())
    conv = F.struct("call.conv_id").alias("conv")
    long = work.save(ids.groupBy(conv).agg(F.count("*").alias("n")).where(f"n > {FOLDED}").select("conv"))
    if long.isEmpty():
        return _folded(ids, waits)
    part = lambda rows, how: rows.withColumn("conv", conv).join(long, "conv", how).drop("conv")
    return _folded(part(ids, "left_anti"), part(waits, "left_anti")).unionByName(_by_rounds(work, work.save(part(ids, "left_semi")), work.save(part(waits, "left_semi"))))


def _folded(ids: DataFrame, waits: DataFrame) -> DataFrame:
    """Levels of conversations of up to FOLDED calls: in each step a call gets a level if all that it waits for have one."""
    after = waits.groupBy("call").agg(F.collect_list("after.id").alias("after"))
    node = F.struct(F.col("call.id").alias("id"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    rows = ids.join(after, "call", "left").groupBy(F.struct("call.conv_id").alias("conv")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    at = F.transform("nodes", lambda x: F.transform(x["after"], lambda a: F.array_position(F.col("nodes.id"), a).cast("int") - 1))
    rows = rows.select("conv", "nodes", at.alias("at"))

    def step(levels: Column, _: Column) -> Column:
        def one(after: Column) -> Column:
            below = F.transform(after, lambda i: F.get(levels, i))
            return F.when(~F.exists(below, lambda x: x.isNull()), F.coalesce(F.array_max(below), F.lit(-1).cast("long")) + 1)

        return F.transform("at", one)

    none = F.transform("at", lambda x: F.lit(None).cast("long"))
    solved = rows.select("conv", "nodes", F.aggregate(F.sequence(F.lit(1), F.size("at")), none, step).alias("levels"))
    each = solved.select("conv.conv_id", F.explode(F.arrays_zip(F.col("nodes.id").alias("id"), F.col("levels").alias("level"))).alias("x"))
    return each.select("conv_id", F.col("x.id").alias("call_id"), F.col("x.level").alias("level"))


def _by_rounds(work: Workspace, ids: DataFrame, waits: DataFrame) -> DataFrame:
    """Levels of conversations of any size, by rounds of joins."""
    counts = waits.groupBy("call").agg(F.count("*").alias("n"), F.first("after").alias("after"))
    one = F.col("n") == 1
    nodes = work.save(ids.join(counts, "call", "left").select(
        "call", F.coalesce("n", F.lit(0)).alias("n"), F.when(one, F.col("after")).otherwise(F.col("call")).alias("at"), F.when(one, 1).otherwise(0).cast("long").alias("far"), F.coalesce(one, F.lit(False)).alias("open")
    ))
    state = nodes.drop("n")
    for _ in range(min(ROUNDS, max(1, nodes.count()).bit_length() + 1)):
        if state.where("open").isEmpty():
            break
        ahead = state.select(F.col("call").alias("at"), F.col("at").alias("next_at"), F.col("far").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(ahead, "at").select("call", F.col("next_at").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("still").alias("open"))
        state = work.save(state.where("NOT open").unionByName(moved))
    solved = nodes.where("n = 0").select(F.col("call").alias("at"), F.lit(0).cast("long").alias("base"))
    several = nodes.where("n > 1").select("call", "n")
    if not several.isEmpty():
        # A call behind a circle keeps an anchor that is never solved.
        edges = waits.join(several, "call").join(state.select(F.col("call").alias("after"), "at", "far", "open"), "after")
        edges = work.save(edges.select("call", "n", F.when(~F.col("open"), F.col("at")).alias("at"), (F.col("far") + 1).alias("far")))
        new, known, done = solved, edges.select("call", F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("base")).limit(0), [solved]
        while not new.isEmpty():
            hits = edges.join(new, "at").groupBy("call").agg(F.count("*").alias("got"), F.max(F.col("far") + F.col("base")).alias("base"))
            known = work.save(known.unionByName(hits).groupBy("call").agg(F.sum("got").alias("got"), F.max("base").alias("base")))
            full = known.join(several, "call").where("got = n")
            new = work.save(full.select(F.col("call").alias("at"), "base"))
            known = known.join(new.select(F.col("at").alias("call")), "call", "left_anti")
            done.append(new)
        solved = done[0]
        for more in done[1:]:
            solved = solved.unionByName(more)
    level = F.when(~F.col("open"), F.col("far") + F.col("base")).alias("level")
    return state.join(solved, "at", "left").select("call.conv_id", F.col("call.id").alias("call_id"), level)


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted array of what is wrong with the arguments (JSON text) of a call.

    schemas: tool -> field -> (type, required), types string, integer, number, boolean, object and array.
    Errors: unknown_tool, not_an_object, missing:field, type:field, unexpected:field. A null value of a field
    that isn't required is right.
    """
    listed = {tool: [{"field": f, "kind": kind, "required": needed} for f, (kind, needed) in sorted(fields.items())] for tool, fields in schemas.items()}
    known = F.from_json(F.lit(json.dumps(listed)), "map<string,array<struct<field:string,kind:string,required:boolean>>>")
    fields = F.try_element_at(known, name)
    given = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    kind_of = lambda v: F.schema_of_variant(v)

    def wrong(f: Column) -> Column:
        kind = kind_of(F.try_element_at(given, f["field"]))
        fits = (
            F.when(kind == "VOID", ~f["required"]).when(f["kind"] == "string", kind == "STRING").when(f["kind"] == "boolean", kind == "BOOLEAN").when(f["kind"] == "integer", kind == "BIGINT")
            .when(f["kind"] == "number", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")).when(f["kind"] == "object", kind.startswith("OBJECT")).when(f["kind"] == "array", kind.startswith("ARRAY"))
        )
        absent = ~F.array_contains(F.map_keys(given), f["field"])
        return F.when(absent, F.when(f["required"], F.concat(F.lit("missing:"), f["field"]))).when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("type:"), f["field"]))

    extra = F.transform(F.array_except(F.map_keys(given), F.transform(fields, lambda f: f["field"])), lambda k: F.concat(F.lit("unexpected:"), k))
    errors = F.array_sort(F.concat(F.filter(F.transform(fields, wrong), lambda e: e.isNotNull()), extra))
    return F.when(fields.isNull(), F.array(F.lit("unknown_tool"))).when(given.isNull(), F.array(F.lit("not_an_object"))).otherwise(errors)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each conversation and identifier of a call or a result.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after_ids (array of the calls whose results it waits
    for, or null). results: conv_id, turn, call_id, content. Columns conv_id, call_id, status (linked, no_result, no_call,
    conflict), n_calls, n_results, name, level, errors, valid, linked (canonical JSON). An identifier counts within
    its conversation only. Of several calls or results with one identifier the first by turn, then by content, counts;
    n_calls and n_results tell how many there were, and where they differ the status is conflict. Rows
    with a null identifier are left out; a call in a circle has a null level. Further columns are ignored.
    """
    digest = lambda *names: F.xxhash64(*(x for n in names for x in (n, F.isnull(n))))
    differ = lambda *names: (F.min(digest(*names)) != F.max(digest(*names))).alias("differ")
    some = lambda rows: rows.where("call_id IS NOT NULL").groupBy(_key("call_id").alias("call"))
    first = some(calls).agg(F.min(F.struct("turn", "name", "arguments", "after_ids")).alias("c"), F.count("*").alias("n_calls"), differ("name", "arguments", "after_ids"))
    answer = some(results).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"), differ("content").alias("others"))
    order = levels(first.select("call.conv_id", F.col("call.id").alias("call_id"), F.col("c.after_ids").alias("after_ids")))
    order = order.select(_key("call_id").alias("call"), "level")
    both = first.join(order, "call", "left").join(answer.hint("shuffle_hash"), "call", "full")
    status = F.when(F.coalesce("differ", F.lit(False)) | F.coalesce("others", F.lit(False)), "conflict")
    status = status.when(F.col("n_calls").isNull(), "no_call").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    errors = F.when(F.col("n_calls").isNotNull(), argument_errors(F.col("c.name"), F.col("c.arguments"), schemas))
    out = both.select(
        "call.conv_id", F.col("call.id").alias("call_id"), status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("c.name").alias("name"), "level", errors.alias("errors"), F.col("c.arguments").alias("arguments"), F.col("r.content").alias("content"), F.array_sort("c.after_ids").alias("after_ids"),
    )
    body = F.to_json(F.struct("after_ids", F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result")))
    return out.withColumns({"valid": F.size("errors") == 0, "linked": body}).drop("arguments", "content", "after_ids")


#: Tools of the query below.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "lang": ("string", False)},
    "count": {"text": ("string", True), "exact": ("boolean", True)},
    "measure": {"length": ("number", True), "unit": ("string", True), "options": ("object", False)},
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of conversation turns by rule, as the table has none of its own.

    Each assistant turn is a call with arguments made from its text; it waits for the assistant turn before it
    (two turns back), that of turn 5 for turn 1 as well. The turn that follows a call is its result. Turns without a
    conversation or a number make identifiers that are null, which link() leaves out; a null text counts as empty.
    """
    identity = lambda shift: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") + shift).cast("string"))
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    kind = F.pmod(n, F.lit(4))
    search = F.to_json(F.struct(text.alias("query"), F.pmod(n, F.lit(50)).alias("limit")))
    count = F.to_json(F.struct((n % 2 == 0).alias("exact"), text.alias("text"), F.when(n % 7 == 0, F.lit(1)).alias("other")))
    measure = F.to_json(F.struct(F.lit("chars").alias("unit"), F.when(n % 5 == 0, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit(".5"))).alias("length")))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", identity(0).alias("call_id"),
        F.when(kind == 0, "search").when(kind == 1, "count").when(kind == 2, "measure").otherwise("search").alias("name"),
        F.when(kind == 1, count).when(kind == 2, measure).when(kind == 3, F.concat(F.lit("{\"query\": "), n.cast("string"))).otherwise(search).alias("arguments"),
        F.when(F.col("turn") == 5, F.array(identity(-2), identity(-4))).otherwise(F.array(identity(-2))).alias("after_ids"),
    )
    results = turns.where("role <> 'assistant' AND turn > 0").select("conv_id", "turn", identity(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked."""
    return link(*calls_of(read(spark, sf_dir, "conversations")), TOOLS).withColumn("errors", F.array_join("errors", ","))
