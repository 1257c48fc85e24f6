from flowloom.operators import bpmn, conformance, dictionary
from flowloom.sources import readers, writers
from flowloom.streaming import streams
from tests.conftest import rows

NET = conformance.net_from_edges([("a", "b"), ("b", "c")])


def test_replay_and_alignment():
    assert conformance.replay(NET, ["a", "b", "c"]) == (4, 4, 0, 0)
    assert conformance.align(NET, ["a", "b", "c"]) == 0
    assert conformance.align(NET, ["a", "c"]) == 1
    assert conformance.align(NET, ["a", "x", "c"]) == 2
    assert conformance.align(NET, []) == 3
    assert conformance.align(NET, ["a"], prefix=True) == 0
    assert conformance.align(NET, ["c"], suffix=True) == 0
    assert conformance.align(NET, ["a", "b", "c"], limit=0) is None
    p, c, m, r = conformance.replay(NET, ["a", "c"])
    assert (m, r) == (1, 1)


def test_parallel_split_through_silent_steps():
    net = conformance.net_from_edges([("a", "c"), ("b", "c")])
    assert conformance.align(net, ["a", "b", "c"]) == conformance.align(net, ["b", "a", "c"]) == 0
    assert conformance.replay(net, ["b", "a", "c"])[2:] == (0, 0)
    assert conformance.is_sound(net) and conformance.is_sound(NET)


def test_conformance_on_cases(spark):
    cases = spark.createDataFrame([("1", "a->b->c"), ("2", "a->b->c"), ("3", "a->c"), ("4", "")], "case_id string, variant string")
    got = {r.case_id: (r.cost, r.anomaly) for r in conformance.log_conformance(cases, NET).collect()}
    assert got == {"1": (0, False), "2": (0, False), "3": (1, True), "4": (3, True)}
    assert conformance.escaping_precision(cases.filter("case_id < '3'"), NET).first()[0] == 1.0
    assert rows(conformance.average_fitness(conformance.log_conformance(cases.limit(0), NET))) == [(1.0, 0)]


def test_cycles_repair_and_cover():
    assert conformance.without_cycles([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")]) == {("b", "c")}
    assert conformance.align(conformance.repaired(NET, ["a", "z"]), ["z", "a", "b", "c"]) == 0
    assert conformance.cover_models([("a", "b"), ("a", "b"), ("c",)]) == [[0, 1], [2]]


def test_alpha_and_inductive():
    relations = {("a", "b"): "->", ("a", "c"): "->", ("b", "d"): "->", ("c", "d"): "->", ("b", "c"): "||", ("c", "b"): "||"}
    pairs = conformance.alpha_pairs(relations, list("abcd"))
    assert [(sorted(x), sorted(y)) for x, y in pairs] == [(["a"], ["b"]), (["a"], ["c"]), (["b"], ["d"]), (["c"], ["d"])]
    net = conformance.alpha_net(pairs, list("abcd"), {"a"}, {"d"})
    assert conformance.align(net, ["a", "c", "b", "d"]) == 0
    edges = {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("c", "b"): 1, ("b", "d"): 1, ("c", "d"): 1}
    assert conformance.inductive_tree(edges, {"a"}, {"d"}) == "->(a, +(b, c), d)"
    assert conformance.inductive_tree({("a", "b"): 1, ("a", "c"): 1}, {"a"}, {"b", "c"}) == "->(a, X(b, c))"
    assert conformance.inductive_tree({("a", "a"): 1}, {"a"}, {"a"}) == "*(a, tau)"


def test_dictionary(spark):
    entries = spark.createDataFrame([("account_number", ["acct_nbr"]), ("customer_name", ["client"])], "preferred_name string, aliases array<string>")
    q = spark.createDataFrame([("ACCT_NBR",), ("accoun_number",), ("xyz123",), (None,)], "query string")
    got = {(r.query, r.rank): r.preferred_name for r in dictionary.match(q, entries, 70.0).collect()}
    assert got == {("ACCT_NBR", 1): "account_number", ("accoun_number", 1): "account_number"}
    assert dictionary.match(q, entries.limit(0)).count() == 0
    assert dictionary.ratio("abcd", "abcd") == dictionary.partial_ratio("bc", "abcd") == 100.0


def test_bpmn_placement():
    g = {"s": ["x"], "x": ["t1", "t2", "t3"], "t1": ["e"], "t2": ["e"], "t3": ["e"], "e": []}
    get = bpmn.mod("Get", ["id"], ["data"])
    needs = {"t1": {"data"}, "t2": {"data"}}
    assert bpmn.branch_aware(g, "s", {"x"}, needs, [get], ["id"]) == [("Get", "t1"), ("Get", "t2")]
    assert bpmn.branch_aware(g, "s", {"x"}, {**needs, "t3": {"data"}}, [get], ["id"]) == [("Get", "x")]
    assert bpmn.branch_aware(g, "s", {"x"}, needs, [get], ["id", "data"]) == []
    chain = [bpmn.mod("B", ["a"], ["b"]), bpmn.mod("A", [], ["a"])]
    assert bpmn.required({"b"}, chain) == ["A", "B"]
    assert bpmn.ordered([bpmn.mod("P", ["q"], ["p"]), bpmn.mod("Q", ["p"], ["q"])]) == ["P", "Q"]
    assert bpmn.common_ancestor(g, "s", ["t1", "t2"]) == "x"
    assert len(list(bpmn.simple_paths(g, "s", "e"))) == 3
    placed = bpmn.nca_placement(g, "s", {"t1": {"b"}, "t2": {"b"}}, chain)
    assert placed == [("A", "x"), ("B", "x")] and not bpmn.placement_errors(g, "s", placed, chain)


def test_round_trips(spark, tmp_path):
    log = spark.createDataFrame([("c1", "a & b", 1, 1_000_000), ("c1", "b", 2, 1_000_000), ("c2", "a", 3, 5_000_000)], "case_id string, activity string, event_id bigint, us bigint")
    writers.write_xes(log, str(tmp_path / "log"))
    assert rows(readers.read_xes(spark, str(tmp_path / "log")).select("case_id", "event_no", "activity", "us")) == [("c1", 1, "a & b", 1_000_000), ("c1", 2, "b", 1_000_000), ("c2", 1, "a", 5_000_000)]
    (tmp_path / "m.pnml").write_text(writers.pnml(NET))
    places, transitions, arcs = readers.read_pnml(spark, str(tmp_path / "m.pnml"))
    assert (places.count(), transitions.count(), arcs.count()) == (4, 3, 6)
    (tmp_path / "m.bpmn").write_text(writers.bpmn([("a", "b")]))
    nodes, flows = readers.read_bpmn(spark, str(tmp_path / "m.bpmn"))
    assert (nodes.count(), rows(flows)) == (4, [("a", "b"), ("b", "end"), ("start", "a")])
    assert [writers.append_new(log, str(tmp_path / "t"), ["event_id"]) for _ in range(2)] == [3, 0]


def test_trie():
    t = streams.trie({"V1": list("ABCD"), "V2": list("ABEF"), "V3": list("AGH")}, {"C"})
    node = 0
    for a in "ABCCD":
        node = streams.advance(t, node, a)
    assert t["passing"][node] == ["V1"]
    assert streams.advance(t, node, "Z") == 0


def test_stream_matches_batch(spark, tmp_path):
    data = [("c", "A", 1), ("c", "B", 2), ("d", "A", 1), ("d", "Z", 2)]
    spark.createDataFrame(data, "case_id string, activity string, us bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_of(spark, str(tmp_path / "in"), "case_id string, activity string, us bigint")
    out = streams.finished(streams.match_in_progress(stream, streams.trie({"V": ["A", "B"], "W": ["A"]})), "update")
    assert rows(out.select("case_id", "passing", "n_events")) == [("c", "V", 2), ("d", "V,W", 2)]
