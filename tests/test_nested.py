import json

from logosmill.operators import nested as N

RECORD = {
    "body": {"self_ref": "#/body", "children": [{"$ref": "#/groups/0"}, {"cref": "#/texts/9"}], "label": "unspecified"},
    "groups": [{"self_ref": "#/groups/0", "parent": {"$ref": "#/body"}, "children": None, "label": "list"}],
    "texts": [
        {"self_ref": "#/texts/0", "parent": {"cref": "#/groups/0"}, "label": "text", "text": "one", "captions": [{"$ref": "#/body"}]},
        {"self_ref": "#/texts/1", "parent": {"$ref": "#/body"}, "children": ["#/texts/0"], "label": "text"},
        {"self_ref": "#/texts/2", "parent": {"$ref": "#/texts/2"}, "label": "text"},
    ],
}
LINKS = {("#/body", "#/groups/0", "both"), ("#/groups/0", "#/texts/0", "parent"), ("#/texts/1", "#/texts/0", "children"), ("#/body", "#/texts/1", "parent"), ("#/texts/2", "#/texts/2", "parent")}


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, payload string, version string, pre int")


def test_links_keep_both_directions_and_loops(spark):
    text = json.dumps(RECORD)
    occ = N.occurrences(records(spark, [(1, text, "x", 1), (1, text, "y", 2)]))
    got = {tuple(r)[1:] for r in N.links_by_containment(occ).collect()}
    assert got == LINKS
    own = [r for r in occ.collect() if r.is_primary]
    assert {r.self_ref for r in own} == {"#/body", "#/groups/0", "#/texts/0", "#/texts/1", "#/texts/2"}
    assert all(r.pre < r.post for r in own)
    tables = N.element_tables(occ)
    assert {r.text for r in tables["texts"].collect()} == {"one", None}
    assert {r.self_ref for r in N.subtree(occ, 1, "#/groups/0").collect()} == {"#/texts/0"}


def test_unusable_payloads(spark):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, '{"body": ', "", 0), (4, "[1]", "", 0), (5, '{"body": NaN}', "", 0), (None, "{}", "", 0), (6, '{"texts": [{"self_ref": 3}, 7, null]}', "", 0)]
    assert N.occurrences(records(spark, rows)).count() == 0
    assert N.links_by_containment(N.occurrences(records(spark, []))).count() == 0


def test_two_versions_and_lone_surrogate(spark):
    a = json.dumps({"body": {"self_ref": "b", "children": [{"$ref": "t"}]}, "texts": [{"self_ref": "t", "text": "\ud800x"}]})
    b = json.dumps({"body": {"self_ref": "b"}, "texts": [{"self_ref": "t", "parent": {"$ref": "b"}}]})
    got = N.links_by_containment(N.occurrences(records(spark, [(1, a, "", 0), (1, b, "", 0)]))).collect()
    assert [tuple(r)[:3] for r in got] == [(1, "b", "t")]


def test_records_of_any_depth(spark):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    text = '{"body": {"self_ref": "b", "children": [{"$ref": "t"}]}, "texts": [{"self_ref": "t", "label": "x", "data": %s, "more": {"k": [true, "a\\u00e9", -1.5e3]}}]}' % deep
    occ = N.occurrences(records(spark, [(1, text, "", 0), (2, text[:-1], "", 0), (3, text + "x", "", 0), (4, text.replace('"k": [', '"k" ['), "", 0)])).collect()
    assert [(r.record_id, r.self_ref, r.label) for r in occ] == [(1, "b", None), (1, "t", "x")]
    assert occ[1].content == '{"data": ' + deep + ', "more": {"k": [true, "a\\u00e9", -1500.0]}}'


def test_deep_reader_agrees_with_the_plain_one():
    for text in ('{}', '[]', ' [1, -2.5e-3 , "a\\n\\u00e9", {"b": null, "b": [ ]}] ', '"x"', '0', 'true'):
        assert N.loads_deep(text) == json.loads(text) and N.dumps_deep(json.loads(text)) == json.dumps(json.loads(text), sort_keys=True)
    for text in ("", "[1,]", "{1:2}", "[1 2]", '{"a" 1}', "01", "[", "nul", '"\n"', "[NaN]", "1 1", '{"a":1,}'):
        try:
            N.loads_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)
