from flowloom.operators import nested
from tests.conftest import rows

NODE = "struct<event_id: string, activity: string, event_level: int"
SCHEMA = f"row_id bigint, event_id string, depth string, sub_activities array<{NODE}, sub_activities: array<{NODE}>>>>"


def test_flatten(spark):
    deep = [("x1", "a", 3), None, (None, "b", 3)]
    data = [
        (1, "t1", "x", [("m1", "a", 2, deep), None, (None, None, None, None), ("m3", "c", 2, [])]),
        (2, None, "x", [("m4", "d", 2, [("x2", None, None)])]),
        (3, "t3", "x", None),
        (4, "t4", "x", []),
        (5, "t1", "x", [("m1", "a", 2, [None])]),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    f = nested.flatten(df, "row_id", "event_id", "sub_activities")
    assert rows(f.nodes.drop("state")) == sorted(
        [(1, "1", "t1", "m1", 2), (1, "1.1", "m1", "x1", 3), (1, "1.3", "m1", "", 3), (1, "3", "t1", "", 2), (1, "4", "t1", "m3", 2), (2, "1", "", "m4", 2), (2, "1.1", "m4", "x2", 3), (5, "1", "t1", "m1", 2)],
        key=repr,
    )
    kinds = {k: v.count() for k, v in f.subtypes.items()}
    assert kinds == {"leaf": 4, "empty": 1, "gappy": 2, "branch": 1}
    assert f.subtypes["branch"].first().own_activity == "d"
    assert nested.flatten(df.limit(0), "row_id", "event_id", "sub_activities").nodes.count() == 0
