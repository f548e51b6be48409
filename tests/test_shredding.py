import json

from conftest import rows
from pagelode.operators import shredding as S


def run(spark, docs):
    df = spark.createDataFrame([(str(i), d, "clash") for i, d in docs], "id string, data string, path string")
    nodes = S.shred(df, "id", "data", (S.SIGNALS + "[].id", S.SIGNALS + ".*", S.TYPES + "[].name", S.TYPES + ".*"))
    take = lambda x, k: x.select("id", "child_pos", "name").withColumnRenamed("name", k)
    return rows(take(S.signal_rows(nodes), "n")), rows(take(S.type_rows(nodes), "n"))


def test_shapes(spark):
    listed = {"layeredScore": {"signals": [None, {"id": "a", "x": {"id": "no"}}, {"id": "b"}, {"id": "a"}]}, "structuredData": {"typesFound": ["T", None, ["U", ["T"]]]}}
    keyed = {"layered_score": {"signals": {"k": {"score": 1}, "n": None, "m": {"id": "ignored"}}}, "structured_data": {"types_found": "One"}}
    docs = [
        (1, json.dumps(listed)), (2, json.dumps(keyed)), (3, json.dumps({"payload": json.dumps(listed)})), (4, json.dumps(json.dumps(keyed))),
        (5, '{"layeredScore": {"signals": [{"id": NaN}]}}'), (6, "{broken"), (7, None), (8, ""), (9, "null"), (10, json.dumps({"layeredScore": None, "structuredData": {"typesFound": []}})), (1, json.dumps(listed)),
    ]
    signals, types = run(spark, docs)
    one, two = [(0, "a"), (1, "b"), (2, "a")], [(0, "k"), (1, "m")]
    assert signals == sorted([(i, *x) for i in ("1", "3") for x in one] + [(i, *x) for i in ("2", "4") for x in two])
    assert types == sorted([(i, *x) for i in ("1", "3") for x in [(0, "T"), (1, "U"), (2, "T")]] + [(i, 0, "One") for i in ("2", "4")])


def test_no_rows_and_deep(spark):
    assert run(spark, []) == ([], [])
    deep = '{"layeredScore": {"signals": ' + "[" * 300 + '{"id": "deep"}' + "]" * 300 + "}}"
    assert run(spark, [(1, deep)])[0] == [("1", 0, "deep")]


def test_whole_document_is_a_table(spark):
    df = spark.createDataFrame([("1", '{"a": {"b": [1, {"c": null}]}}')], "id string, j string")
    got = [(r.node, r.parent, r.label, r.ordinal, r.path, r.kind, r.scalar) for r in S.shred(df, "id", "j").orderBy("node").collect()]
    assert got == [(0, -1, None, 0, "", "object", None), (1, 0, "a", 0, "a", "object", None), (2, 1, "b", 0, "a.b", "list", None), (3, 2, None, 0, "a.b[]", "scalar", "1"), (4, 2, None, 1, "a.b[]", "object", None), (5, 4, "c", 0, "a.b[].c", "null", None)]
