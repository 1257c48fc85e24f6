"""Models and conformance: Petri nets, token replay, alignments, precision, discovery on small graphs.

Models are small and live on the driver; whatever grows with the log is aggregated to variants first, and each
distinct variant is replayed or aligned once, inside Arrow batches, then joined back to its cases.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.logs import with_next
from flowloom.operators.variants import SEP, numbered


@dataclass(frozen=True)
class Net:
    """A Petri net with labelled transitions; a silent transition has the label None."""

    transitions: tuple[tuple[str, str | None, frozenset, frozenset], ...]  # id, label, input places, output places
    initial: frozenset = field(default_factory=lambda: frozenset({"initial"}))
    final: frozenset = field(default_factory=lambda: frozenset({"final"}))

    def labels(self) -> set[str]:
        return {t[1] for t in self.transitions if t[1] is not None}


def net_from_edges(edges: Iterable[tuple[str, str]]) -> Net:
    """A place for each edge, one initial and one final place for the sources and sinks."""
    edges = sorted(set(edges))
    nodes = sorted({n for e in edges for n in e})
    before = {n: {f"p_{a}_{b}" for a, b in edges if b == n} or {"initial"} for n in nodes}
    after = {n: {f"p_{a}_{b}" for a, b in edges if a == n} or {"final"} for n in nodes}
    starts = [n for n in nodes if before[n] == {"initial"}]
    stops = [n for n in nodes if after[n] == {"final"}]
    if len(starts) > 1 or len(stops) > 1:  # several sources share the initial token through silent splits
        before |= {n: {f"i_{n}"} for n in starts}
        after |= {n: {f"f_{n}"} for n in stops}
        silent = [("split", None, frozenset({"initial"}), frozenset(f"i_{n}" for n in starts)), ("join", None, frozenset(f"f_{n}" for n in stops), frozenset({"final"}))]
    else:
        silent = []
    return Net((*((n, n, frozenset(before[n]), frozenset(after[n])) for n in nodes), *silent))


def strongly_connected(edges: Iterable[tuple[str, str]]) -> dict[str, int]:
    """Component numbers of the nodes of a small graph (two depth-first passes)."""
    edges = set(edges)
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in sorted({n for e in edges for n in e}):
        stack = [(root, iter(sorted(out.get(root, []))))] if root not in seen else []
        seen.add(root)
        while stack:
            node, following = stack[-1]
            nxt = next((x for x in following if x not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(out.get(nxt, [])))))
    number: dict[str, int] = {}
    for i, root in enumerate(reversed(order)):
        todo = [root] if root not in number else []
        while todo:
            n = todo.pop()
            if n not in number:
                number[n] = i
                todo += [x for x in back.get(n, []) if x not in number]
    return number


def without_cycles(edges: Iterable[tuple[str, str]]) -> set[tuple[str, str]]:
    """Every edge inside a strongly connected component goes, self loops too."""
    edges = set(edges)
    number = strongly_connected(edges)
    return {(a, b) for a, b in edges if number[a] != number[b]}


def repaired(net: Net, activities: Iterable[str]) -> Net:
    """Missing activities become transitions of their own between two new places."""
    extra = sorted(set(activities) - net.labels())
    return Net((*net.transitions, *((a, a, frozenset({f"in_{a}"}), frozenset({f"out_{a}"})) for a in extra)), net.initial | {f"in_{a}" for a in extra}, net.final | {f"out_{a}" for a in extra})


def is_sound(net: Net, limit: int = 100_000) -> bool:
    """From every reachable marking the final one can be reached, no place holds two tokens, no transition is dead."""
    start = tuple(sorted(net.initial))
    seen, todo, back, fired = {start}, [start], {}, set()
    while todo:
        m = todo.pop()
        for i, (_, _, pre, post) in enumerate(net.transitions):
            if pre <= set(m):
                rest = set(m) - pre
                if rest & post:
                    return False
                fired.add(i)
                n = tuple(sorted(rest | post))
                back.setdefault(n, set()).add(m)
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
                    if len(seen) > limit:
                        raise ValueError(f"more than {limit} markings")
    end = tuple(sorted(net.final))
    able, todo = {end}, [end]
    while todo:
        for m in back.get(todo.pop(), ()):
            if m not in able:
                able.add(m)
                todo.append(m)
    return seen <= able and len(fired) == len(net.transitions)


def replay(net: Net, trace: Sequence[str]) -> tuple[int, int, int, int]:
    """(produced, consumed, missing, remaining) of token replay; silent transitions fire when they enable the next step.

    Of several transitions with one label the one that misses fewest tokens fires. An activity that the net lacks
    counts as a token missing and a token remaining.
    """
    by_label: dict[str, list[tuple]] = {}
    for t in net.transitions:
        if t[1] is not None:
            by_label.setdefault(t[1], []).append(t)
    foreign = 0
    silent = [t for t in net.transitions if t[1] is None]
    marking: dict[str, int] = dict.fromkeys(net.initial, 1)
    p, c, m = len(net.initial), 0, 0

    def enable(need: frozenset) -> tuple[int, int]:
        made = used = 0
        for _ in range(len(silent)):
            if all(marking.get(x, 0) for x in need):
                break
            ready = [t for t in silent if all(marking.get(x, 0) for x in t[2]) and any(not marking.get(x, 0) for x in t[3] & need)]
            if not ready:
                break
            for x in ready[0][2]:
                marking[x] -= 1
            for x in ready[0][3]:
                marking[x] = marking.get(x, 0) + 1
            made, used = made + len(ready[0][3]), used + len(ready[0][2])
        return made, used

    for a in trace:
        if a not in by_label:
            p, c, m, foreign = p + 1, c + 1, m + 1, foreign + 1
            continue
        t = min(by_label[a], key=lambda t: sum(not marking.get(x, 0) for x in t[2]))
        made, used = enable(t[2])
        p, c = p + made, c + used
        for x in t[2]:
            if marking.get(x, 0):
                marking[x] -= 1
            else:
                m += 1
            c += 1
        for x in t[3]:
            marking[x] = marking.get(x, 0) + 1
            p += 1
    made, used = enable(net.final)
    p, c = p + made, c + used
    for x in net.final:
        if marking.get(x, 0):
            marking[x] -= 1
        else:
            m += 1
        c += 1
    return p, c, m, sum(marking.values()) + foreign


def align(net: Net, trace: Sequence[str], limit: int | None = None, prefix: bool = False, suffix: bool = False) -> int | None:
    """Cost of a cheapest alignment (log move 1, model move 1, silent and synchronous 0) by Dijkstra's search.

    ``prefix`` lets the model stop early, ``suffix`` lets it start anywhere reachable, both together align an infix. The
    search is exact; only a caller's ``limit`` of opened states may end it, with None instead of a guess.
    """
    starts = {tuple(sorted(net.initial))}
    if suffix:
        todo = list(starts)
        while todo:
            m = todo.pop()
            for _, _, pre, post in net.transitions:
                if pre <= set(m):
                    n = tuple(sorted((set(m) - pre) | post))
                    if n not in starts:
                        starts.add(n)
                        todo.append(n)
    end = tuple(sorted(net.final))
    queue, best = [(0, 0, m) for m in sorted(starts)], {(0, m): 0 for m in starts}
    heapq.heapify(queue)
    opened = 0
    while queue:
        cost, i, m = heapq.heappop(queue)
        if cost > best[(i, m)]:
            continue
        if i == len(trace) and (prefix or m == end):
            return cost
        opened += 1
        if limit is not None and opened > limit:
            return None
        steps = [(cost + 1, i + 1, m)] if i < len(trace) else []
        for _, label, pre, post in net.transitions:
            if pre <= set(m):
                n = tuple(sorted((set(m) - pre) | post))
                steps.append((cost + (label is not None), i, n))
                if i < len(trace) and label == trace[i]:
                    steps.append((cost, i + 1, n))
        for s in steps:
            if s[0] < best.get(s[1:], 1 << 60):
                best[s[1:]] = s[0]
                heapq.heappush(queue, s)
    return None


def variant_conformance(variants: DataFrame, net: Net) -> DataFrame:
    """Per variant (column variant, steps joined by '->') replay fitness, alignment cost and fitness.

    Alignment fitness is 1 - cost / (trace length + cost of the empty trace).
    """
    empty = align(net, [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v in pdf["variant"]:
                trace = v.split(SEP) if v else []
                p, c, m, r = replay(net, trace)
                cost = align(net, trace)
                worst = len(trace) + (empty or 0)
                rows.append((v, 0.5 * (1 - m / c) + 0.5 * (1 - r / p) if c and p else 1.0, cost, None if cost is None else 1 - cost / worst if worst else 1.0))
            yield pd.DataFrame(rows, columns=["variant", "replay_fitness", "cost", "fitness"]).astype({"cost": "Int32"})

    return variants.select("variant").distinct().mapInPandas(run, "variant string, replay_fitness double, cost int, fitness double")


def log_conformance(cases: DataFrame, net: Net) -> DataFrame:
    """Per case its fitness and whether it is an anomaly; cases: case_id, variant."""
    scored = variant_conformance(cases, net)
    return cases.select("case_id", "variant").join(scored, "variant").withColumn("anomaly", F.col("fitness") < 1)


def average_fitness(scored: DataFrame) -> DataFrame:
    """The mean fitness, 1.0 for an empty log."""
    return scored.agg(F.coalesce(F.avg("fitness"), F.lit(1.0)).alias("avg_fitness"), F.count_if("anomaly").alias("n_anomalies"))


def escaping_precision(cases: DataFrame, net: Net) -> DataFrame:
    """Precision by escaping edges on the log's prefix automaton: 1 - escaping / allowed, weighted by cases.

    Variants are aggregated first and walked through the model as far as it follows; each step leaves a row of bounded
    size with a digest of its prefix, so the work grows with the length of the variants, not with its square.
    """

    def silent_closure(marks: set[tuple]) -> set[tuple]:
        todo = list(marks)
        while todo:
            m = todo.pop()
            for _, label, pre, post in net.transitions:
                if label is None and pre <= set(m) and (x := tuple(sorted((set(m) - pre) | post))) not in marks:
                    marks.add(x)
                    todo.append(x)
        return marks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for variant, n in zip(pdf["variant"], pdf["n"]):
                marks, seen = silent_closure({tuple(sorted(net.initial))}), hashlib.sha256()
                for a in [*(variant.split(SEP) if variant else []), None]:
                    allowed = sorted({label for m in marks for _, label, pre, _ in net.transitions if label is not None and pre <= set(m)})
                    rows.append((seen.hexdigest(), allowed, a, n))
                    if a is None or a not in allowed:
                        break
                    seen.update(f"{len(a)}:{a}".encode())
                    marks = silent_closure({tuple(sorted((set(m) - pre) | post)) for m in marks for _, label, pre, post in net.transitions if label == a and pre <= set(m)})
            yield pd.DataFrame(rows, columns=["prefix", "allowed", "next", "n"], dtype=object).astype({"n": "int64"})

    variants = cases.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    steps = variants.mapInPandas(run, "prefix string, allowed array<string>, next string, n bigint")
    seen = steps.groupBy("prefix").agg(F.first("allowed").alias("allowed"), F.collect_set("next").alias("seen"), F.sum("n").alias("n"))
    one = seen.agg(F.sum(F.size("allowed") * F.col("n")).alias("a"), F.sum(F.size(F.array_except("allowed", "seen")) * F.col("n")).alias("e"))
    return one.select(F.coalesce(1 - F.col("e") / F.nullif(F.col("a"), F.lit(0)), F.lit(1.0)).alias("precision"))


def generalization(log: DataFrame, net: Net) -> DataFrame:
    """1 - the mean over the labelled transitions of 1 / sqrt(number of executions), 1 where there are none."""
    spark = log.sparkSession
    transitions = spark.createDataFrame([(t[0], t[1]) for t in net.transitions if t[1] is not None], "id string, activity string")
    done = log.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    each = transitions.join(done, "activity", "left").select(F.coalesce(1 / F.sqrt("n"), F.lit(1.0)).alias("x"))
    return each.agg(F.coalesce(1 - F.avg("x"), F.lit(1.0)).alias("generalization"))


def partial_alignments(variants: DataFrame, net: Net) -> DataFrame:
    """(variant, prefix_cost, postfix_cost, infix_cost): the model may stop early, start late, or both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v in pdf["variant"]:
                trace = v.split(SEP) if v else []
                rows.append((v, align(net, trace, prefix=True), align(net, trace, suffix=True), align(net, trace, prefix=True, suffix=True)))
            yield pd.DataFrame(rows, columns=["variant", "prefix_cost", "postfix_cost", "infix_cost"])

    return variants.select("variant").distinct().mapInPandas(run, "variant string, prefix_cost int, postfix_cost int, infix_cost int")


def replay_summary(scored: DataFrame) -> DataFrame:
    """The mean replay fitness (1.0 for an empty log) and the number of cases with problems."""
    return scored.agg(F.coalesce(F.avg("replay_fitness"), F.lit(1.0)).alias("avg_replay_fitness"), F.count_if(F.col("replay_fitness") < 1).alias("n_with_problems"), F.count(F.lit(1)).alias("n_cases"))


def repair_loop(cases: DataFrame, net: Net, threshold: float = 0.8, attempts: int = 5) -> tuple[Net, list[tuple[int, float, int]]]:
    """While the mean replay fitness is below ``threshold``, give the net a transition for each activity that it
    lacks; stops at the threshold, when no activity is missing any more, or after ``attempts``.

    Returns the net and (attempt, fitness, activities added after it). Each attempt replays every variant once.
    """
    activities = sorted(r[0] for r in cases.select(F.explode(F.split("variant", SEP)).alias("a")).filter("a <> ''").distinct().collect())
    history = []
    for attempt in range(1, attempts + 1):
        fitness = float(replay_summary(cases.join(variant_conformance_by_replay(cases, net), "variant")).first()["avg_replay_fitness"])
        missing = sorted(set(activities) - net.labels())
        history.append((attempt, fitness, 0 if fitness >= threshold else len(missing)))
        if fitness >= threshold or not missing:
            break
        net = repaired(net, missing)
    return net, history


def variant_conformance_by_replay(variants: DataFrame, net: Net) -> DataFrame:
    """(variant, replay_fitness) without alignments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [replay(net, v.split(SEP) if v else []) for v in pdf["variant"]]
            yield pd.DataFrame({"variant": pdf["variant"], "replay_fitness": [0.5 * (1 - m / c) + 0.5 * (1 - r / p) if c and p else 1.0 for p, c, m, r in counts]})

    return variants.select("variant").distinct().mapInPandas(run, "variant string, replay_fitness double")


def unified_loops(log: DataFrame) -> DataFrame:
    """Per case the edges between first occurrences of activities: a repeated activity is the node of its first
    occurrence. (case_id, src, dst, n), self loops included."""
    nxt = with_next(log).filter("next_activity is not null")
    return nxt.groupBy("case_id", F.col("activity").alias("src"), F.col("next_activity").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def merged_pairwise(orders: Sequence[Iterable[tuple[str, str]]]) -> set[tuple[str, str]]:
    """Partial orders merged one after another, cycles removed after each merge, so the order of merging counts."""
    out: set[tuple[str, str]] = set()
    for edges in orders:
        out = without_cycles(out | set(edges))
    return out


def rolled_up(tree: DataFrame, weight: str = "count") -> dict[str, float]:
    """Conformance of every node of a process tree from that of its leaves: sum(v * w) / sum(w) from the leaves up.

    tree: node, parent, value (of leaves), n (their number of occurrences); weight 'count' uses n, 'equal' 1. The tree
    of a model is small and is rolled up on the driver; leaves without a value weigh nothing.
    """
    rows = {r["node"]: r for r in tree.collect()}
    children: dict[str | None, list[str]] = {}
    for n, r in rows.items():
        children.setdefault(r["parent"], []).append(n)
    done: dict[str, tuple[float, float]] = {}

    def up(node: str) -> tuple[float, float]:
        if node not in children:
            r = rows[node]
            done[node] = (0.0, 0.0) if r["value"] is None else (float(r["value"]), float(r["n"]) if weight == "count" else 1.0)
        else:
            parts = [up(c) for c in children[node]]
            total = sum(w for _, w in parts)
            done[node] = (sum(v * w for v, w in parts) / total if total else 0.0, total if weight == "count" else float(total > 0))
        return done[node]

    for root in children.get(None, []):
        up(root)
    return {n: v for n, (v, w) in done.items() if w}


def simplicity(net: Net, reference_degree: float = 2.0) -> float:
    """1 / (1 + the mean arc degree of the nodes above a reference degree)."""
    degree: dict[str, int] = {}
    for i, (_, _, pre, post) in enumerate(net.transitions):
        degree[f"t{i}"] = len(pre) + len(post)
        for x in [*pre, *post]:
            degree[f"p{x}"] = degree.get(f"p{x}", 0) + 1
    return 1 / (1 + max(0.0, sum(degree.values()) / max(1, len(degree)) - reference_degree))


def alpha_pairs(relations: dict[tuple[str, str], str], activities: Sequence[str]) -> list[tuple[frozenset, frozenset]]:
    """The maximal pairs (A, B) of the alpha algorithm: all of A before all of B, none related within A or B."""
    related = {p for p, r in relations.items() if r in ("->", "<-", "||")}
    causal = {p for p, r in relations.items() if r == "->"}

    def free(s: Iterable[str]) -> bool:
        return all((x, y) not in related and (y, x) not in related for x, y in combinations(s, 2)) and all((x, x) not in related for x in s)

    found = {(frozenset({a}), frozenset({b})) for a, b in causal if free([a]) and free([b])}
    todo = list(found)
    while todo:
        a, b = todo.pop()
        for x in activities:
            for grown in ((a | {x}, b), (a, b | {x})):
                if grown not in found and free(grown[0]) and free(grown[1]) and all((p, q) in causal for p in grown[0] for q in grown[1]):
                    found.add(grown)
                    todo.append(grown)
    return sorted(((a, b) for a, b in found if not any((a, b) != (c, d) and a <= c and b <= d for c, d in found)), key=lambda p: (sorted(p[0]), sorted(p[1])))


def alpha_net(pairs: Sequence[tuple[frozenset, frozenset]], activities: Sequence[str], starts: set[str], stops: set[str]) -> Net:
    """The alpha algorithm's net."""
    pre: dict[str, set] = {a: {"initial"} if a in starts else set() for a in activities}
    post: dict[str, set] = {a: {"final"} if a in stops else set() for a in activities}
    for i, (a, b) in enumerate(pairs):
        for x in a:
            post[x].add(f"p{i}")
        for x in b:
            pre[x].add(f"p{i}")
    return Net(tuple((a, a, frozenset(pre[a]), frozenset(post[a])) for a in activities))


def inductive_tree(edges: dict[tuple[str, str], int], starts: set[str], stops: set[str], activities: Iterable[str] | None = None, noise: float = 0.0) -> str:
    """D3, K7: a process tree by cuts of the directly-follows graph: exclusive, sequence, parallel, loop, else a flower.

    ``noise`` drops edges rarer than that share of their source's most frequent one. Trees read X(..), ->(..), +(..), *(..).
    """
    nodes = sorted(activities if activities is not None else {n for e in edges for n in e} | starts | stops)
    if noise:
        top = {a: max((n for (x, _), n in edges.items() if x == a), default=0) for a in nodes}
        edges = {e: n for e, n in edges.items() if n >= noise * top[e[0]]}
    if len(nodes) == 1:
        return f"*({nodes[0]}, tau)" if (nodes[0], nodes[0]) in edges else nodes[0]

    def groups(linked) -> list[list[str]]:
        left, out = set(nodes), []
        while left:
            todo, part = [min(left)], set()
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += [y for y in left if y not in part and linked(x, y)]
            left -= part
            out.append(sorted(part))
        return sorted(out)

    def sub(part: list[str], s: set[str], e: set[str]) -> str:
        inner = {k: n for k, n in edges.items() if k[0] in part and k[1] in part}
        return inductive_tree(inner, s & set(part) or set(part), e & set(part) or set(part), part)

    has = lambda a, b: (a, b) in edges
    parts = groups(lambda a, b: has(a, b) or has(b, a))
    if len(parts) > 1:
        return "X(" + ", ".join(sub(p, starts, stops) for p in parts) + ")"
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a in nodes:
            reach[a] |= {y for x in list(reach[a]) for y in nodes if has(x, y)}
    parts = groups(lambda a, b: (b in reach[a]) == (a in reach[b]))
    if len(parts) > 1:
        parts.sort(key=lambda p: -len(reach[p[0]]))
        out = []
        for p in parts:
            s = {b for (a, b) in edges if b in p and a not in p} | (starts & set(p))
            e = {a for (a, b) in edges if a in p and b not in p} | (stops & set(p))
            tree = sub(p, s, e)
            skippable = any(a not in p and b not in p and max(parts.index(q) for q in parts if a in q) < parts.index(p) < min(parts.index(q) for q in parts if b in q) for a, b in edges)
            out.append(f"X({tree}, tau)" if skippable else tree)
        return "->(" + ", ".join(out) + ")"
    parts = groups(lambda a, b: not (has(a, b) and has(b, a)))
    if len(parts) > 1 and all(set(p) & starts and set(p) & stops for p in parts):
        return "+(" + ", ".join(sub(p, starts, stops) for p in parts) + ")"
    body = starts | stops
    rest = [n for n in nodes if n not in body]
    if rest:
        redo = [a for a in rest if all(x in stops or x in rest for x, y in edges if y == a) and all(y in starts or y in rest for x, y in edges if x == a)]
        if redo and len(redo) == len(rest):
            done = sorted(set(nodes) - set(redo))
            return f"*({sub(done, starts, stops)}, {sub(redo, set(redo), set(redo))})"
    return "*(tau, " + ", ".join(nodes) + ")"


def parsed_tree(text: str) -> tuple:
    """A tree as nested (operator, children) from its string; leaves are labels, 'tau' is silent."""
    tokens = re.findall(r"->\(|[X+*]\(|[(),]|[^(),]+", re.sub(r"\s*,\s*", ",", text))
    at = 0

    def node():
        nonlocal at
        token = tokens[at].strip()
        at += 1
        if token not in ("->(", "X(", "+(", "*("):
            return token
        children = []
        while True:
            children.append(node())
            at += 1
            if tokens[at - 1] == ")":
                return token[:-1], children

    return node()


def net_from_tree(text: str) -> Net:
    """The net of a process tree: sequence, exclusive choice, parallel branches with silent split and join, and
    loops, whose first child is the body and whose other children lead back to it."""
    transitions: list[tuple] = []
    places = itertools.count()

    def fire(label: str | None, pre: set[str], post: set[str]) -> None:
        transitions.append((f"t{len(transitions)}", label, frozenset(pre), frozenset(post)))

    def build(node, a: str, b: str) -> None:
        if isinstance(node, str):
            fire(None if node == "tau" else node, {a}, {b})
            return
        kind, children = node
        if kind == "->":
            stops = [a, *(f"p{next(places)}" for _ in children[1:]), b]
            for child, x, y in zip(children, stops, stops[1:]):
                build(child, x, y)
        elif kind == "X":
            for child in children:
                build(child, a, b)
        elif kind == "+":
            ends = [(f"p{next(places)}", f"p{next(places)}") for _ in children]
            fire(None, {a}, {x for x, _ in ends})
            for child, (x, y) in zip(children, ends):
                build(child, x, y)
            fire(None, {y for _, y in ends}, {b})
        else:
            x, y = f"p{next(places)}", f"p{next(places)}"
            fire(None, {a}, {x})
            build(children[0], x, y)
            for child in children[1:]:
                build(child, y, x)
            fire(None, {y}, {b})

    build(parsed_tree(text), "initial", "final")
    return Net(tuple(transitions))


def tree_text(node) -> str:
    """The string of a tree as parsed_tree gives it."""
    return node if isinstance(node, str) else f"{node[0]}({', '.join(map(tree_text, node[1]))})"


def tree_rows(text: str, frozen: Iterable[str] = ()) -> list[dict]:
    """A tree as rows (node, parent, place, label, frozen), in pre-order; ``frozen`` are strings of subtrees. A node
    is frozen if it or one above it is."""
    kept, out = set(frozen), []

    def walk(node, parent: int | None, place: int, held: bool) -> None:
        number, held = len(out), held or tree_text(node) in kept
        out.append({"node": number, "parent": parent, "place": place, "label": node if isinstance(node, str) else node[0], "frozen": held})
        for i, child in enumerate([] if isinstance(node, str) else node[1]):
            walk(child, number, i, held)

    walk(parsed_tree(text), None, 0, False)
    return out


def tree_from_rows(rows: Iterable[dict]) -> tuple[str, list[str]]:
    """The tree of such rows and the largest frozen subtrees."""
    rows = sorted(rows, key=lambda r: (r["parent"] is not None, r["parent"], r["place"]))
    below: dict[int | None, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    frozen: list[str] = []

    def build(r: dict, held: bool):
        children = [build(c, held or r["frozen"]) for c in below.get(r["node"], [])]
        node = (r["label"], children) if children else r["label"]
        if r["frozen"] and not held:
            frozen.append(tree_text(node))
        return node

    return tree_text(build(below[None][0], False)), frozen


def extended_tree(text: str, variants: Iterable[Sequence[str]]) -> str:
    """The tree that also allows the given variants: those that do not fit become choices of their own beside it.

    The tree itself stays as it is, frozen parts and all; empty variants make it optional.
    """
    net, extra = net_from_tree(text), []
    for v in variants:
        if align(net, v) != 0 and tuple(v) not in extra:
            extra.append(tuple(v))
    if not extra:
        return text
    sequences = ["tau" if not v else v[0] if len(v) == 1 else ("->", list(v)) for v in extra]
    return tree_text(("X", [parsed_tree(text), *sequences]))


def cover_models(variants: Sequence[tuple[str, ...]]) -> list[list[int]]:
    """Greedily assign variants to sequence models: each goes to the first model that replays it perfectly, else
    it founds a new one. Returns the variants' numbers by model.

    A sequence model replays its own sequence and no other, so the founded models are looked up by sequence.
    """
    models: dict[tuple[str, ...], list[int]] = {}
    for i, v in enumerate(variants):
        models.setdefault(tuple(v), []).append(i)
    return list(models.values())


def model_cover(vs: DataFrame) -> DataFrame:
    """(model, variant): cover_models over all variants of vs (variant, frequency), the most frequent first.

    Variants are distinct, so each founds the model of its place in that order.
    """
    return numbered(vs).select((F.col("n") - 1).alias("model"), "variant")
