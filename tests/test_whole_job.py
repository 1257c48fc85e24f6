"""Registered queries on small tables whose whole result is known, so that a cut in a query shows."""

from datetime import datetime, timedelta

import pytest

from flowloom.operators import conformance, stats
from flowloom.plans import graphs, models, process, relations
from tests.conftest import rows


def events_of(spark, at, sequences):
    """An events table with one user, and so one case, for each sequence."""
    start = datetime(2024, 1, 1)
    data = [(100 * i + j, i, start + timedelta(minutes=j), a, float(j), '{"k": 1}') for i, s in enumerate(sequences) for j, a in enumerate(s)]
    spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return str(at)


def test_v11_covers_every_variant(spark, tmp_path):
    sequences = [["view"] * (i + 1) for i in range(25)] + [["view"]]
    got = models.QUERIES["v11_model_cover"](spark, events_of(spark, tmp_path, sequences)).collect()
    assert {r.variant for r in got} == {"->".join(s) for s in sequences} and len(got) == 25
    order = [r.variant for r in sorted(got, key=lambda r: r.model)]
    assert order[0] == "view"  # the most frequent one
    assert [(r.model, r.variant) for r in sorted(got, key=lambda r: r.model)] == [(i, order[j]) for i, m in enumerate(conformance.cover_models([tuple(v.split("->")) for v in order])) for j in m]


def test_cover_finds_a_founded_model_by_its_sequence():
    many = [("a",) * (i % 3000 + 1) for i in range(6000)]
    assert conformance.cover_models(many) == [[i, i + 3000] for i in range(3000)]
    assert conformance.cover_models([("a", "b"), ("b", "a"), ("a", "b")]) == [[0, 2], [1]]
    assert conformance.cover_models([]) == []


def test_g18_links_an_event_to_every_other_of_its_journey(spark, tmp_path):
    journeys = {"j1": [("z", "web_portal"), ("a", "core_ledger"), ("m", "mobile_app")], "j2": [("p", "web_portal"), ("q", "web_portal")], "j3": [("x", "mail_room")], None: [("n", "web_portal"), ("o", "core_ledger")]}
    data = [(e, app, j) for j, members in journeys.items() for e, app in members] + [("z", "web_portal", "j1"), (None, "core_ledger", "j1")]
    spark.createDataFrame(data, "event_id string, app_name string, journey_id string").write.parquet(f"{tmp_path}/journey_events.parquet")
    want = {(a, b) for j, members in journeys.items() if j for a, _ in members for b, _ in members if a != b}
    assert rows(graphs.QUERIES["g18_linked_events"](spark, str(tmp_path))) == sorted(want, key=repr)


def test_g22_reaches_over_all_line_items_by_real_ids(spark, tmp_path):
    items = [(1, 60, 5, 40.0), (2, 60, 1, 2.0), (2, 1051, 2, 30.0), (51, 1051, 1, 1.0), (51, 7, 1, 1.0), (77, 9, 1, 2.0), (None, 60, 1, 1.0), (1, None, 1, 1.0)]
    spark.createDataFrame(items, "l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {e for s, p, *_ in items if s and p for e in ((f"supplier:{s}", f"part:{p}"), (f"part:{p}", f"supplier:{s}"))}
    want, front = {"supplier:1": 0}, {"supplier:1"}
    for i in range(1, 4):
        front = {y for x, y in edges if x in front} - set(want)
        want |= dict.fromkeys(front, i)
    assert dict(rows(graphs.QUERIES["g22_reachable"](spark, str(tmp_path)))) == want and want["part:1051"] == 3 and "supplier:51" not in want


def test_j8_drops_placeholders_and_keeps_short_keys(spark, tmp_path):
    events = [("w1", "web_portal", ["ord-1332", "N/A"]), ("w2", "web_portal", [" undefined ", "k", None]), ("w3", "web_portal", ["a-key-of-some-length", ""]), ("m1", "mobile_app", ["ord-1332"]), ("w4", "web_portal", None)]
    events += [("s1", "score_svc", ["ord-1332", " undefined ", "N/A"]), ("s2", "score_svc", ["k", "", None, "a-key-of-some-length"])]
    spark.createDataFrame(events, "event_id string, app_name string, correlation_keys array<string>").write.parquet(f"{tmp_path}/journey_events.parquet")
    spark.createDataFrame([("",), ("n/a",), ("undefined",)], "placeholder string").write.parquet(f"{tmp_path}/placeholder_keys.parquet")
    assert rows(relations.QUERIES["j8_overlapping_keys"](spark, str(tmp_path))) == [("w1", "s1"), ("w2", "s2"), ("w3", "s2")]


def test_o12_has_a_column_for_every_category_but_the_first(spark, tmp_path):
    at = events_of(spark, tmp_path, [["view", "click", "purchase"], ["signup", "error", "view"]])
    got = relations.QUERIES["o12_one_hot"](spark, at)
    assert got.columns == ["event_id", "is_error", "is_purchase", "is_signup", "is_view"]
    assert sorted(rows(got)) == [(0, 0, 0, 0, 1), (1, 0, 0, 0, 0), (2, 0, 1, 0, 0), (100, 0, 0, 1, 0), (101, 1, 0, 0, 0), (102, 0, 0, 0, 1)]
    with pytest.raises(ValueError):
        stats.categories(spark.range(3), "id", most=2)


def test_k5_exports_the_model_of_the_log(spark, tmp_path):
    at = events_of(spark, tmp_path / "some", [["view", "error", "signup"], ["view", "signup"], ["view", "error", "signup"]])
    got = models.QUERIES["k5_pnml"](spark, at).first()
    assert all(f'<transition id="{a}">' in got.pnml for a in ("view", "error", "signup")) and "click" not in got.pnml + got.bpmn
    flows = [("view", "error"), ("error", "signup"), ("view", "signup"), ("start", "view"), ("signup", "end")]
    assert got.bpmn.count("sequenceFlow id") == 5 and all(f'sourceRef="{a}" targetRef="{b}"' in got.bpmn for a, b in flows)
    none = models.QUERIES["k5_pnml"](spark, events_of(spark, tmp_path / "none", [])).first()
    assert "<transition" not in none.pnml and "<bpmn:task" not in none.bpmn


def test_k5_keeps_activities_that_follow_each_other_both_ways(spark, tmp_path):
    got = models.QUERIES["k5_pnml"](spark, events_of(spark, tmp_path, [["a", "b"], ["b", "a"]])).first()
    assert all(f'<transition id="{x}">' in got.pnml and f'<bpmn:task id="{x}"' in got.bpmn for x in "ab")
    assert 'sourceRef="a" targetRef="b"' in got.bpmn and 'sourceRef="b" targetRef="a"' in got.bpmn


def test_v16_compares_variants_of_the_log(spark, tmp_path):
    v16 = process.QUERIES["v16_compare_variants"]
    assert rows(v16(spark, events_of(spark, tmp_path / "both", [["click", "view"], ["view", "signup"], ["click", "view"]]))) == [("click", "signup")]
    assert rows(v16(spark, events_of(spark, tmp_path / "one", [["click", "view"]]))) == []
