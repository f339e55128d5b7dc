"""Tool-call linking: calls and results meet by identifier, are put in topological order, validated and written as canonical JSON.

With DataFrame functions only. Input of link(): calls (call_id, name, arguments as JSON text, after: the identifiers it depends
on) and results (call_id, content). Output, one row for each distinct call and for each distinct result that answers none:

- status: ``linked``, ``unanswered``, ``orphan_result`` (no such call), ``extra_result`` (the call has an earlier one);
- level: 0 for calls that depend on no other call, else one more than the largest level of those they depend on, so that the order
  (level, call_id) is topological; null for calls on a cycle or after one, and for results;
- errors: what the schemas find in the arguments, in the order of the schema, then unknown parameters by name;
- n_calls and n_results: the rows that hold this call, and all results of the identifier;
- json: keys in the order of their code units, no white space, UTF-8 not escaped; equal records give equal texts. Arguments that
  aren't JSON stay the text that they are.

Levels: chains of calls with one dependency each are shortened by pointer doubling, in rounds that grow with the logarithm of their
length. What is left are the calls with several dependencies; a round places those whose dependencies are all placed, so there
are as many rounds as such calls depend on one another. Each round is written to the shared folder.

Skew: equal calls and equal results are counted before any shuffle; of the results of an identifier the smallest content is its
answer, a minimum that combines before the shuffle, so no join makes more than a row for each distinct call or result.

Edge cases: a null call_id never links: such calls are unanswered and such results orphans; dependencies on identifiers that no call has
are ignored; several different calls of one identifier all get its answer and are told apart by n_ids; null arguments are
an error; a null content is an answer with null content; an empty table gives an empty result; other columns aren't read. Arguments
that Spark's variant type can't take stay the text that they are, so nothing of them is lost: a string of over 20,000,000 characters, 128 MiB in
all, nesting over 1,000 deep, a number of over 1,000 digits, a key of over 50,000 characters or a key twice. They can't be validated, and count as "no JSON
object"; texts of over 20,000,000 characters that can't be read as "too large or no JSON object". Numbers keep their notation as far as
decimals do (1e2 and 100 are different texts); arguments with a number of over 38 digits (digits within strings don't matter) stay as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm.common import table, written

#: The tools that turns of a conversation are taken for, with each parameter's type and whether it must be there.
SCHEMAS = {
    "assistant.configure": {"text": ("string", True), "turn": ("integer", True)},
    "assistant.reply": {"text": ("string", True), "turn": ("integer", True)},
}
#: Fixed values of the variant type: the digits of its decimals, and the characters of its longest string.
DIGITS = 38
LARGEST = 20_000_000
#: The beginnings of the type names that a variant has for each type of JSON schema.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def canonical(text: Column) -> Column:
    """The JSON text with sorted keys and no white space; null if it isn't JSON (or has a key twice).

    A text with a number that a decimal of DIGITS digits can't hold stays as it is, so that no digit is lost.
    """
    made, many = F.to_json(F.try_parse_json(text)), F.lit(rf"[0-9.]{{{DIGITS + 1},}}")
    outside = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', '""')  # without strings, in valid JSON
    return F.when(made.isNotNull() & F.rlike(text, many) & F.rlike(outside, many), text).otherwise(made)


def errors_of(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with the arguments of a call, as an array of texts."""
    parsed = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    found = F.array(F.lit("unknown tool"))
    for tool, parameters in sorted(schemas.items()):
        each = []
        for p, (kind, required) in parameters.items():
            value = F.try_variant_get(parsed, f"$['{p}']", "variant")
            is_kind = F.lit(False)
            for start in TYPES[kind]:
                is_kind = is_kind | F.startswith(F.schema_of_variant(value), F.lit(start))
            absent = F.array(F.lit(f"missing {p}")) if required else none
            each.append(F.when(value.isNull(), absent).when(~is_kind, F.array(F.lit(f"{p} is no {kind}"))).otherwise(none))
        unknown = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, parameters))))
        each.append(F.transform(F.coalesce(unknown, none), lambda k: F.concat(F.lit("unknown "), k)))
        found = F.when(name == tool, F.concat(*each)).otherwise(found)
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    unread = F.when(parsed.isNull() & (F.length(arguments) > LARGEST), F.array(F.lit("arguments are too large or no JSON object")))
    return F.when(F.coalesce(is_object, F.lit(False)), found).otherwise(F.coalesce(unread, F.array(F.lit("arguments are no JSON object"))))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, after); no row for calls on a cycle or after one."""
    calls = calls.where("call_id is not null")
    ids = written(calls.select("call_id").distinct(), "ids")
    edges = calls.select("call_id", F.explode("after").alias("dep")).where("dep is not null").distinct()
    edges = written(edges.join(ids.select(F.col("call_id").alias("dep")), "dep", "left_semi"), "edges")
    degrees = written(edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("dep").alias("dep")), "degrees")
    chained = degrees.where("n = 1").select("call_id", "dep")
    anchors = ids.join(chained, "call_id", "left_anti")
    places = _along_chains(chained).union(anchors.select("call_id", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("steps")))
    first = anchors.join(degrees, "call_id", "left_anti").select(F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("level"))
    forks = degrees.where("n > 1").select("call_id")
    if not forks.isEmpty():
        places, first = written(places, "places"), written(first, "first")
        first = _over_forks(edges.join(forks, "call_id", "left_semi"), places, first)
    return places.join(first, "anchor").select("call_id", (F.col("steps") + F.col("level")).cast("int").alias("level"))


def _along_chains(chained: DataFrame) -> DataFrame:
    """(call_id, anchor, steps) of calls (call_id, dep) with one dependency: where following it ends, by pointer doubling.

    The rounds grow with the logarithm of the longest chain. What has no end by then is on a cycle or after one and has no row.
    """
    is_link = chained.select(F.col("call_id").alias("dep"), F.lit(True).alias("on"))
    hops = chained.join(is_link, "dep", "left").select("call_id", F.col("dep").alias("anchor"), F.lit(1).cast("long").alias("steps"), F.col("on").isNull().alias("ended"))
    hops = written(hops, "hops")
    for _ in range(hops.count().bit_length() + 1):
        going = hops.where("not ended")
        if going.isEmpty():
            break
        next_ = hops.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("_a"), F.col("steps").alias("_s"), F.col("ended").alias("_e"))
        moved = going.join(next_, "anchor").select("call_id", F.col("_a").alias("anchor"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_e").alias("ended"))
        hops = written(hops.where("ended").union(moved), "hops")
    return hops.where("ended").select("call_id", "anchor", "steps")


def _over_forks(edges: DataFrame, places: DataFrame, placed: DataFrame) -> DataFrame:
    """(anchor, level) of placed and of the calls with several dependencies (edges: call_id, dep), round by round."""
    far = edges.join(places.select(F.col("call_id").alias("dep"), "anchor", "steps"), "dep", "left")
    far = written(far.groupBy("call_id", "anchor").agg((F.max("steps") + 1).alias("steps")), "forks")
    waiting = written(far.groupBy("call_id").agg(F.count("*").alias("missing"), F.lit(0).cast("long").alias("level")), "waiting")
    out = placed
    while True:
        met = far.join(placed, "anchor").groupBy("call_id").agg(F.count("*").alias("now"), F.max(F.col("level") + F.col("steps")).alias("_l"))
        left = waiting.join(met, "call_id", "left")
        waiting = written(left.select("call_id", (F.col("missing") - F.coalesce("now", F.lit(0))).alias("missing"), F.greatest("level", "_l").alias("level")), "waiting")
        placed = waiting.where("missing = 0").select(F.col("call_id").alias("anchor"), "level")
        waiting = waiting.where("missing > 0")
        if placed.isEmpty():
            return out
        out = out.union(placed)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """(status, call_id, level, name, errors, n_calls, n_ids, n_results, json); see the module."""
    calls = written(calls.groupBy("call_id", "name", "arguments", "after").agg(F.count("*").alias("n_calls")), "calls")
    results = written(results.groupBy("call_id", "content").agg(F.count("*").alias("n")), "results")
    answers = results.groupBy("call_id").agg(F.min(F.struct(F.col("content").isNull().alias("none"), "content")).alias("answer"), F.sum("n").alias("n_results"))
    answers = answers.where("call_id is not null")
    known = calls.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_ids"))
    linked = calls.join(answers, "call_id", "left").join(known, "call_id", "left").join(levels(calls), "call_id", "left")
    quoted = F.to_json(F.array("arguments"), {"ignoreNullFields": "false"})
    raw = F.coalesce(canonical(F.col("arguments")), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    made = linked.select(
        F.when(F.col("answer").isNull(), "unanswered").otherwise("linked").alias("status"),
        "call_id",
        "level",
        "name",
        errors_of(F.col("name"), F.col("arguments"), schemas).alias("errors"),
        "n_calls",
        F.coalesce("n_ids", F.lit(1)).alias("n_ids"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        _record(raw, F.col("call_id"), F.col("name"), F.col("answer.content")).alias("json"),
    )
    rest = results.join(known, "call_id", "left").join(answers.select("call_id", "answer"), "call_id", "left")
    rest = rest.where("n_ids is null or not (content <=> answer.content)")
    other = rest.select(
        F.when(F.col("n_ids").isNull(), "orphan_result").otherwise("extra_result"), "call_id", F.lit(None).cast("int"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("n"),
        _record(F.lit("null"), F.col("call_id"), F.lit(None).cast("string"), F.col("content")),
    )
    return made.union(other)


def _record(arguments: Column, call_id: Column, name: Column, result: Column) -> Column:
    """The canonical JSON of a call and its answer; arguments are JSON already."""
    rest = F.to_json(F.struct(call_id.alias("call"), name.alias("name"), result.alias("result")), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user's turn is a call of ``assistant.reply``, a system turn one of ``assistant.configure``; the identifier is
    ``conv_id:turn``. An assistant's turn is the result of the turn before. A call depends on the last two turns before it, as far as they
    are calls. Rows of other roles are results of the turn before, too.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    at = F.concat_ws(":", "conv_id", "turn")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    is_call = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    calls = rows.where(is_call).select(
        F.when(known, at).alias("call_id"),
        F.when(F.col("role") == "system", "assistant.configure").otherwise("assistant.reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.when(known, F.array(*(F.concat_ws(":", "conv_id", F.col("turn") - k) for k in (1, 2)))).alias("after"),
    )
    results = rows.where(~is_call).select(F.when(known, F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(*calls_of_turns(table(spark, sf_dir, "conversations")))
    return found.withColumn("errors", F.concat_ws("; ", "errors"))


ORACLE = """
WITH RECURSIVE calls AS (
  SELECT CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || turn END AS call_id, conv_id, turn, role, text, count(*) AS n_calls
  FROM conversations WHERE role IN ('user', 'system') GROUP BY conv_id, turn, role, text),
results AS (
  SELECT CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || (turn - 1) END AS call_id, text AS content, count(*) AS n
  FROM conversations WHERE coalesce(role NOT IN ('user', 'system'), true) GROUP BY 1, 2),
known AS (SELECT call_id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, count(*) AS n_ids FROM calls WHERE call_id IS NOT NULL GROUP BY call_id),
reach AS (
  SELECT call_id, conv_id, turn, 0 AS level FROM known
  UNION
  SELECT k.call_id, k.conv_id, k.turn, r.level + 1 FROM reach r JOIN known k ON k.conv_id = r.conv_id AND k.turn - r.turn IN (1, 2)),
levels AS (SELECT call_id, max(level) AS level FROM reach GROUP BY call_id),
answers AS (
  SELECT call_id, min(content) AS content, sum(n) AS n_results FROM results WHERE call_id IS NOT NULL GROUP BY call_id)
SELECT CASE WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, c.call_id, l.level,
       CASE c.role WHEN 'system' THEN 'assistant.configure' ELSE 'assistant.reply' END AS name,
       concat_ws('; ', CASE WHEN c.text IS NULL THEN 'missing text' END, CASE WHEN c.turn IS NULL THEN 'missing turn' END) AS errors,
       c.n_calls, coalesce(k.n_ids, 1) AS n_ids, CAST(coalesce(a.n_results, 0) AS BIGINT) AS n_results,
       '{"arguments":{' || concat_ws(',', '"text":' || to_json(c.text), '"turn":' || c.turn) || '},"call":' || coalesce(to_json(c.call_id), 'null')
         || ',"name":"assistant.' || CASE c.role WHEN 'system' THEN 'configure' ELSE 'reply' END || '","result":' || coalesce(to_json(a.content), 'null') || '}' AS json
FROM calls c LEFT JOIN answers a USING (call_id) LEFT JOIN known k USING (call_id) LEFT JOIN levels l USING (call_id)
UNION ALL
SELECT CASE WHEN k.call_id IS NULL THEN 'orphan_result' ELSE 'extra_result' END, r.call_id, NULL, NULL, '', 0, 0, r.n,
       '{"arguments":null,"call":' || coalesce(to_json(r.call_id), 'null') || ',"name":null,"result":' || coalesce(to_json(r.content), 'null') || '}'
FROM results r LEFT JOIN answers a USING (call_id) LEFT JOIN known k USING (call_id)
WHERE k.call_id IS NULL OR r.content IS DISTINCT FROM a.content
"""
