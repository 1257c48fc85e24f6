"""Groups of records linked by shared tokens: connected components by low-diameter decomposition.

Every row is a vertex and is linked to the smallest row of each of its tokens (keys, earlier group, own id), so no
pairs within a group are formed. Then, until no edge is left: every vertex draws an exponential head start, clusters
grow from the earliest starters one hop a step, each vertex joining the cluster that reaches it first; clusters
contract to super-vertices, and the edges between clusters go to the next round. The rounds' assignments are composed
backwards. Each round's edges and assignments are written to the checkpoint folder, so lineage stays short and a lost
executor costs no recomputation of earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.instants import BLANKS
from flowloom.session import cut

#: Rate of the exponential head starts, and the most hops that a cluster grows in a round.
BETA, HOPS = 0.25, 6


def key_form(key: Column) -> Column:
    """A key's normal form: case, surrounding blanks and quotation marks ignored."""
    return F.lower(F.btrim(key, F.lit(BLANKS + "'\"")))


#: A head start and its tie-break in one number: _HOP is one hop, the lowest 40 bits break ties of cut-off starts.
_HOP, _TIE = 1 << 60, (1 << 40) - 1


def head_start(vertex: Column, seed: int) -> Column:
    """An exponential draw in units of _HOP, cut off at HOPS, with a tie-break; it depends on vertex and seed only."""
    uniform = (F.pmod(F.xxhash64(vertex, F.lit(str(seed))), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    start = F.floor(F.least(-F.log(uniform) / BETA, F.lit(float(HOPS))) * (1 << 20)).cast("long")
    return F.shiftleft(start, 40).bitwiseOR(F.xxhash64(vertex, F.lit(str(seed + 1))).bitwiseAND(_TIE))


def _grow(left: DataFrame, seed: int) -> DataFrame:
    """(v, c): the cluster of each vertex of the edges (a, b), which are distinct, a <> b.

    A hop is one join of the edges with the clusters reached so far and one maximum by vertex, combined before the
    shuffle. Every vertex has a loop, which carries its own cluster over, so a hop reads the last one's result once and
    the plan of a round grows with its hops, not with a power of them. A head start below one hop reaches nobody.
    """
    both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    vertices = both.select("a").distinct()
    both = both.unionByName(vertices.select("a", F.col("a").alias("b")))
    state = vertices.select(F.col("a").alias("v"), F.col("a").alias("c"), head_start(F.col("a"), seed).alias("m"))
    for _ in range(HOPS):
        reached = F.col("m") - F.when(F.col("a") == F.col("b"), 0).otherwise(_HOP)
        offers = both.join(state, F.col("a") == F.col("v")).select(F.col("b").alias("v"), "c", reached.alias("m")).filter("m >= 0")
        state = offers.groupBy("v").agg(F.max_by("c", "m").alias("c"), F.max("m").alias("m"))
    return state.select("v", "c")


def components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 1) -> DataFrame:
    """(v, root): for every vertex of an edge the root of its component; equal roots mean connected.

    Vertices are bigint. Loops, repeated edges and either direction are allowed; rows with a null end are left out.
    Roots are vertices of the component, but not always the smallest. Chains of any length come out whole: a round
    shortens them by a constant factor, and rounds go on, distributed to the last, until no edge joins two clusters.
    """
    one = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a is not null and b is not null")
    every = one.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    left = cut(one.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not left.isEmpty():
        cluster = cut(_grow(left, seed + 7 * len(levels)))
        levels.append(cluster)
        ca, cb = cluster.select(F.col("v").alias("a"), F.col("c").alias("ca")), cluster.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        joined = left.join(ca, "a").join(cb, "b").filter("ca <> cb")
        left = cut(joined.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if not levels:
        return every.select("v", F.col("v").alias("root"))
    roots = levels[-1].select("v", F.col("c").alias("root"))
    for cluster in reversed(levels[:-1]):
        up = roots.withColumnRenamed("v", "c")
        roots = cluster.join(up, "c", "left").select("v", F.coalesce("root", "c").alias("root"))
    return every.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def linked_rows(tokens: DataFrame) -> DataFrame:
    """Edges (a, b) from each row to the smallest row that shares one of its tokens; ``tokens`` has row and token.

    A token's smallest row is an aggregation with map-side combine, so a token that holds a third of all rows is one
    row a task of it. Where its rows meet that row again, AQE splits them, whatever the token's share of all rows.
    """
    hub = tokens.groupBy("token").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "b")
    return tokens.join(hub, "token").filter("row <> b").select(F.col("row").alias("a"), "b")


def journeys(events: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(event_id, group_id): one row for each distinct non-null event_id; group_id is the group's smallest event_id.

    Events are linked by a shared key (key_form; nulls and placeholders link nothing), a shared non-null journey_id or
    a shared event_id, directly or through others, in any number of steps. Rows without an event_id still link the
    events that share their keys. Null and empty key arrays, null elements and repeated keys link nothing more;
    repeated rows change nothing; an empty table gives an empty table. Other columns are ignored.
    """
    void = [r[0] for r in placeholders.select(key_form(F.col("placeholder"))).distinct().limit(10_001).collect()]
    rows = events.select(F.monotonically_increasing_id().alias("row"), "event_id", "correlation_keys", "journey_id")
    own = F.when(F.col("event_id").isNotNull(), F.concat(F.lit("e:"), "event_id"))
    prior = F.when(F.col("journey_id").isNotNull(), F.concat(F.lit("j:"), "journey_id"))
    keys = F.transform(F.coalesce("correlation_keys", F.array()), lambda k: F.when(key_form(k) != "", F.concat(F.lit("k:"), key_form(k))))
    tokens = F.filter(F.array_distinct(F.concat(F.array(own, prior), keys)), lambda t: t.isNotNull())
    exploded = rows.select("row", F.explode(tokens).alias("token"))
    if len(void) <= 10_000:
        exploded = exploded.filter(~F.col("token").isin([f"k:{p}" for p in void if p is not None]))
    else:
        named = placeholders.select(F.concat(F.lit("k:"), key_form(F.col("placeholder"))).alias("token")).distinct()
        exploded = exploded.join(named, "token", "left_anti")
    exploded = cut(exploded)
    roots = components(linked_rows(exploded))
    of_row = exploded.filter(F.col("token").startswith("e:")).select("row", F.substring("token", 3, 1 << 30).alias("event_id"))
    placed = of_row.join(roots, of_row["row"] == roots["v"], "left").select("event_id", F.coalesce("root", "row").alias("root"))
    # redelivered events fall together here: one row for each event and root, before the smallest is sought
    placed = cut(placed.groupBy("event_id").agg(F.min("root").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("event_id").alias("group_id"))
    return placed.join(smallest, "root").select("event_id", "group_id")
