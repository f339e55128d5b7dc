import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from farebox.llm import toolcalls as tc

SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False), "tags": ("array", False), "exact": ("boolean", False), "boost": ("number", False), "opts": ("object", False)}}


def frames(spark, calls, results):
    return (
        spark.createDataFrame([(*c, "x") for c in calls], "call_id string, name string, arguments string, after array<string>, level string"),
        spark.createDataFrame([(*r, "x") for r in results], "call_id string, content string, name string"),
    )


def linked(spark, calls, results=()):
    return tc.link(*frames(spark, calls, list(results)), SCHEMAS).collect()


def test_validation_and_canonical_json(spark):
    cases = {
        '{"query": "é\\n\\"x\\"", "limit": 3}': [],
        '{ "limit" : 3, "query":"a", "tags":[1, {"b":1,"a":2}], "exact":true, "boost":1.5, "opts":{} }': [],
        '{"limit": "3"}': ["missing query", "limit is no integer"],
        '{"query": 1, "tags": {}, "zeta": 1, "alpha": null}': ["query is no string", "tags is no array", "unknown alpha", "unknown zeta"],
        "[1]": ["arguments are no JSON object"],
        "not json": ["arguments are no JSON object"],
        '{"query": "a", "query": "b"}': ["arguments are no JSON object"],
        None: ["arguments are no JSON object"],
    }
    got = {r.call_id: r for r in linked(spark, [(str(i), "search", a, None) for i, a in enumerate(cases)])}
    for i, (a, errors) in enumerate(cases.items()):
        r = got[str(i)]
        assert r.errors == errors and r.status == "unanswered"
        record = json.loads(r.json)
        assert list(record) == ["arguments", "call", "name", "result"]
        if a and errors[:1] != ["arguments are no JSON object"]:
            assert r.json.startswith('{"arguments":' + json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False) + ",")
    assert [r.errors for r in linked(spark, [("1", "other", "{}", None)])] == [["unknown tool"]]


def test_linking_keeps_every_row(spark):
    args = '{"query":"a"}'
    calls = [("a", "search", args, None), ("a", "search", args, None), ("b", "search", args, None), ("b", "search", "{}", None), (None, "search", args, None)]
    results = [("a", "2"), ("a", "1"), ("a", "1"), ("b", None), ("c", "9"), (None, "n")]
    got = sorted((r.status, r.call_id or "-", r.n_calls, r.n_ids, r.n_results) for r in linked(spark, calls, results))
    assert got == [
        ("extra_result", "a", 0, 0, 1), ("linked", "a", 2, 1, 3), ("linked", "b", 1, 2, 1), ("linked", "b", 1, 2, 1),
        ("orphan_result", "-", 0, 0, 1), ("orphan_result", "c", 0, 0, 1), ("unanswered", "-", 1, 1, 0),
    ]
    assert linked(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_levels_against_brute_force(spark, seed):
    rng = random.Random(seed)
    after = {i: [j for j in range(i) if rng.random() < 0.15] for i in range(40)}
    want = {}
    for i in after:
        want[str(i)] = 1 + max((want[str(j)] for j in after[i]), default=-1)
    for i in range(100, 140):  # a chain
        after[i] = [i - 1] if i > 100 else []
        want[str(i)] = i - 100
    after[140], want["140"] = [139, 5], 40
    after[40], after[41], after[42], after[43], after[44] = [41], [40], [41, 3], [41], [44]
    got = {r.call_id: r.level for r in linked(spark, [(str(i), "search", "{}", [*map(str, d), "absent", None]) for i, d in after.items()])}
    assert got == want | dict.fromkeys(map(str, range(40, 45)))


def test_query_against_sql(spark):
    turns = spark.createDataFrame([(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, 0, "user", "x\u0001\u2028\t/", 1), (1, 1, "assistant", "\\é\"", 1), (1, 1, "assistant", "z", 1), (2, None, "assistant", None, 1), (3, 5, None, "", 1), (4, 0, "system", "s" * 100_000, 1), (4, 1, "user", "q", 1), (4, 3, "user", "r", 1)], "conv_id long, turn long, role string, text string, level int")
    for frame in (turns, turns.limit(0), spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")):
        conversations = frame.toPandas()  # noqa: F841
        calls, results = tc.calls_of_turns(frame)
        got = tc.link(calls, results).selectExpr("status", "call_id", "level", "name", "concat_ws('; ', errors) errors", "n_calls", "n_ids", "n_results", "json").collect()
        with duckdb.connect() as con:
            con.register("conversations", con.from_df(conversations).project("conv_id::bigint conv_id, turn::bigint turn, role::varchar role, text::varchar as text") if len(conversations) else con.sql("select 1::bigint conv_id, 1::bigint turn, '' as role, '' as text limit 0"))
            want = con.sql(tc.ORACLE).fetchall()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_large_and_long_arguments(spark):
    digits = '{"a":' + "7" * 42 + "}"
    text = lambda n: '{"turn":1, "text":"' + "x" * n + '"}'
    rows = [("a", digits), ("b", text(20_000_000)), ("c", text(20_000_001)), ("d", "x" * 20_000_001), ("e", "[" * 1001 + "]" * 1001), ("f", "[" * 1000 + "]" * 1000)]
    calls = spark.createDataFrame([(i, "assistant.reply", x, []) for i, x in rows], "call_id string, name string, arguments string, after array<string>")
    got = {r.call_id: r for r in tc.link(calls, spark.createDataFrame([], "call_id string, content string")).collect()}
    told = {i: json.loads(got[i].json)["arguments"] for i in "abcdf"}
    assert told["a"] == {"a": int("7" * 42)}
    assert got["b"].errors == [] and told["b"] == {"text": "x" * 20_000_000, "turn": 1}
    assert all(got[i].errors == ["arguments are too large or no JSON object"] and told[i] == dict(rows)[i] for i in "cd")
    assert got["e"].errors == got["f"].errors == ["arguments are no JSON object"] and isinstance(told["f"], list)


def test_digits_within_strings_dont_matter(spark):
    texts = ['{"b": 1, "a": "%s"}' % ("." * 40), '{ "a":"%s", "b":1}' % ("." * 40), '{"b": "\\\\", "a": "\\"%s"}' % ("1" * 50), '{"b": %s, "a": "x"}' % ("1" * 39)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(tc.canonical(F.col("t"))).collect()]
    assert got[0] == got[1] == '{"a":"%s","b":1}' % ("." * 40)
    assert got[2] == '{"a":"\\"%s","b":"\\\\"}' % ("1" * 50) and got[3] == texts[3]
