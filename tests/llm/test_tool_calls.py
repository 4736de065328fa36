import json
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import tool_calls
from tidemark.llm.queries import op2_orphan_results, op2_tool_calls

CALLS = "conv_id long, call_id string, turn long, place int, name string, arguments string, after array<string>, line string"
RESULTS = "conv_id long, turn long, call_id string, content string, more string"
GOOD = '{"query":"ab","limit":3}'

values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=8,
)


@given(values)
def test_canonical_json_is_a_round_trip(value):
    text = tool_calls.canonical(value)
    assert json.loads(text) == value
    assert tool_calls.canonical(json.loads(text)) == text


def test_canonical_form():
    assert tool_calls.canonical({"b": 1.0, "a": [True, None, "é\n"], "B": 0.5}) == '{"B":0.5,"a":[true,null,"é\\n"],"b":1}'


def test_faults():
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 2}}, "b": {"enum": ["x"]},
                       "c": {"type": "string", "minLength": 2, "maxLength": 3}, "d": {"type": "number", "maximum": 1}},
    }
    assert tool_calls.faults({"a": [2, 3]}, schema) == []
    assert tool_calls.faults([], schema) == ["$: not object"]
    assert tool_calls.faults({"b": "y", "c": "x", "d": 2, "z": 0}, schema) == [
        "$.a: missing", "$.b: not in enum", "$.c: too short", "$.d: above maximum", "$.z: unexpected"
    ]
    assert tool_calls.faults({"a": [1, 2.5, True], "c": "long"}, schema) == [
        "$.a[0]: below minimum", "$.a[1]: not integer", "$.a[2]: not integer", "$.c: too long"
    ]
    assert tool_calls.check_arguments("search", '{"limit": NaN}', tool_calls.SCHEMAS)[1] == ["$: not JSON"]


def plain(calls, results):
    """conv_id, call_id -> (place_no, level, status), one conversation at a time."""
    answered = {(r.conv_id, r.call_id) for r in results}
    groups = defaultdict(dict)
    for c in sorted(calls, key=lambda c: (c.turn, c.place)):
        groups[c.conv_id].setdefault(c.call_id, c)
    found = {}
    for conv, group in groups.items():
        level = {}
        changed = True
        while changed:
            changed = False
            for key, c in group.items():
                before = [a for a in c.after or [] if a in group]
                if key not in level and all(a in level for a in before):
                    level[key] = max((level[a] + 1 for a in before), default=0)
                    changed = True
        order = sorted(group, key=lambda k: (level.get(k, 10**9), group[k].turn, group[k].place, k))
        for at, key in enumerate(order, 1):
            status = "cyclic" if key not in level else "linked" if (conv, key) in answered else "unanswered"
            found[conv, key] = (at, level.get(key), status)
    return found


def test_query_against_one_conversation_at_a_time(spark, folder):
    calls, results = tool_calls.calls_of(spark.read.parquet(f"{folder}/conversations.parquet"))
    rows = op2_tool_calls(spark, folder).collect()
    assert {(r.conv_id, r.call_id): (r.place_no, r.level, r.status) for r in rows} == plain(calls.collect(), results.collect())
    assert len(rows) == calls.count()
    for r in rows:
        line = json.loads(r.line)
        assert tool_calls.canonical(line) == r.line and line["valid"] == (r.faults == "")


def test_graphs(spark):
    def call(conv, name, turn, after, tool="search", arguments=GOOD):
        return (conv, name, turn, 0, tool, arguments, after, "x")

    rows = [
        call(1, "a", 5, []), call(1, "b", 4, ["a"]), call(1, "c", 3, ["b", "a", "gone", None]), call(1, "d", 2, None),
        call(2, "x", 1, ["y"]), call(2, "y", 2, ["x"]), call(2, "z", 3, ["y"]), call(2, "free", 4, ["free2"]),
        call(2, "free2", 5, []), call(2, "self", 6, ["self"]),
        call(3, "a", 2, [], None, None), call(3, "a", 1, [], "search", "not json"), call(3, "a", 1, [], "search", "not json"),
        call(None, "a", 1, []), call(4, None, 1, []), call(5, "a", None, []),
    ]
    calls = spark.createDataFrame(rows, CALLS)
    results = spark.createDataFrame(
        [(1, 9, "a", "late", ""), (1, 7, "a", "first", ""), (9, 1, "a", "no call", ""), (3, 1, "a", None, ""), (1, 1, None, "x", "")],
        RESULTS,
    )
    found = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect()}
    expected = plain([c for c in calls.collect() if None not in (c.conv_id, c.call_id, c.turn)], results.collect())
    assert {k: (r.place_no, r.level, r.status) for k, r in found.items()} == expected
    assert json.loads(found[1, "a"].line)["result"] == "first" and found[1, "a"].repeats == 1
    assert found[3, "a"].faults == "$: not JSON" and found[3, "a"].repeats == 2
    assert json.loads(found[1, "c"].line)["after"] == ["a", "b", "gone"]


def test_long_conversation(spark):
    rows = [(1, f"c{i:04}", i, 0, "search", GOOD, [f"c{i // 2:04}"] if i else [], "") for i in range(3000)]
    calls = spark.createDataFrame(rows, CALLS)
    out = tool_calls.link_calls(calls, spark.createDataFrame([], RESULTS), tool_calls.SCHEMAS).collect()
    assert sorted(r.place_no for r in out) == list(range(1, 3001)) and max(r.level for r in out) == 12


def test_empty_tables(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect() == []


def test_arguments_hold_the_whole_text(spark, folder):
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    calls, _ = tool_calls.calls_of(spark.read.parquet(f"{folder}/conversations.parquet"))
    texts = {(r.conv_id, f"call-{r.turn}"): r.text or "" for r in conversations if r.role == "assistant"}
    for r in calls.collect():
        arguments = json.loads(r.arguments)
        assert arguments.get("query", arguments.get("text")) == texts[r.conv_id, r.call_id]


def test_results_without_a_call_are_rows_of_their_own(spark, folder):
    calls, results = tool_calls.calls_of(spark.read.parquet(f"{folder}/conversations.parquet"))
    known = {(c.conv_id, c.call_id) for c in calls.collect()}
    orphans = {(r.conv_id, r.call_id): r.content for r in results.collect() if (r.conv_id, r.call_id) not in known}
    found = op2_orphan_results(spark, folder).collect()
    assert orphans and len(found) == len(orphans) and {r.status for r in found} == {"orphan"}
    assert {(r.conv_id, r.call_id): json.loads(r.line)["result"] for r in found} == orphans
    linked = op2_tool_calls(spark, folder)
    assert linked.schema == op2_orphan_results(spark, folder).schema
    assert not {(r.conv_id, r.call_id) for r in linked.collect()} & set(orphans)


def test_repeated_and_unusable_orphans(spark):
    calls = spark.createDataFrame([(1, "a", 5, 0, "search", GOOD, [], "x")], CALLS)
    rows = [(1, 9, "a", "linked", ""), (1, 9, "b", "late", ""), (1, 7, "b", None, ""), (None, 1, "a", "x", ""), (2, 1, "a", "y", "")]
    found = tool_calls.orphan_results(calls, spark.createDataFrame(rows, RESULTS)).collect()
    assert sorted((r.conv_id, r.call_id, r.repeats, json.loads(r.line)["result"]) for r in found) == [(1, "b", 1, None), (2, "a", 0, "y")]
    empty = spark.createDataFrame([], RESULTS)
    assert tool_calls.orphan_results(calls, empty).collect() == []


def test_numbers_surrogates_and_depth():
    schema = {"t": {"type": "object", "properties": {"limit": {"type": "integer", "maximum": 9}}}}
    huge = "1" + "0" * 400
    value, bad = tool_calls.check_arguments("t", f'{{"limit": {huge}}}', schema)
    assert bad == ["$.limit: above maximum"] and tool_calls.canonical(value) == f'{{"limit":{huge}}}'
    assert tool_calls.check_arguments("t", f'{{"limit": 1{"0" * 5000}}}', schema) == (None, ["$: not JSON"])
    assert tool_calls.canonical(1e16) == tool_calls.canonical(10**16) and tool_calls.canonical(-0.0) == "0"
    assert tool_calls.canonical(1e300) == tool_calls.canonical(int(1e300)) and tool_calls.canonical(0.5) == "0.5"
    assert tool_calls.canonical({"\ud800": "é\udfffx"}) == '{"\\ud800":"é\\udfffx"}'
    assert tool_calls.canonical("😀") == '"😀"'
    for depth, deep in ((100, False), (101, True), (2000, True), (200_000, True)):
        value, bad = tool_calls.check_arguments("t", "[" * depth + "]" * depth, {})
        assert bad == (["$: nested too deeply"] if deep else ["unknown tool"])
        assert tool_calls.canonical(value) == ("null" if deep else "[" * depth + "]" * depth)


def test_awkward_arguments_end_no_job(spark):
    texts = ['{"limit": 1' + "0" * 400 + "}", '{"a": "\\ud800"}', "[" * 2000 + "]" * 2000, "x" * 300_000, "", None, "NaN", "1e999"]
    shape = "conv_id long, turn int, place int, call_id string, name string, arguments string, after array<string>, level string, at string, first string"
    calls = spark.createDataFrame([(1, 0, i, f"c{i}", "search", t, None, "l", "a", "f") for i, t in enumerate(texts)], shape)
    results = spark.createDataFrame([(1, 1, "c0", "x" * 300_000, "m")], "conv_id long, turn int, call_id string, content string, more string")
    rows = tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).orderBy("place_no").collect()
    assert [r.place_no for r in rows] == list(range(1, len(texts) + 1))
    assert [json.loads(r.line)["valid"] for r in rows] == [False] * len(texts)
    assert rows[2].faults == "$: nested too deeply" and json.loads(rows[3].line)["arguments"] == texts[3]


def test_a_chain_as_deep_as_its_length(spark):
    rows = [(1, i, 0, f"c{i}", "search", "{}", [f"c{i - 1}"] if i else None) for i in range(6)]
    calls = spark.createDataFrame(rows, "conv_id long, turn int, place int, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, turn int, call_id string, content string")
    found = tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).orderBy("place_no").collect()
    assert [(r.call_id, r.level) for r in found] == [(f"c{i}", i) for i in range(6)]
