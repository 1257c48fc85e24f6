"""Schemas that drift from file to file: column profiles, matching between versions, one unified table.

Every field of every file is profiled in one aggregation of bounded state: JSON types, a min-hash sketch of its
values, one of their shapes, cardinality and numeric quartiles. Between neighbouring files of a producer the fields
that vanished and those that appeared form a bipartite graph weighted by the similarity of their data (names only
break ties); a maximum-weight matching gives the renames. Only profiles, one row for each field of a file, are grouped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import cut

#: Hash functions of a value sketch and of a shape sketch.
VALUE_HASHES, SHAPE_HASHES = 32, 8
#: Similarity from which a vanished and an appeared field hold the same data.
SAME_DATA = 0.3
FILE = ["feed", "producer", "file_no"]


def _masks(n: int, salt: int) -> list[int]:
    """n numbers of 64 bits, evenly spread in their highest bits: a hash under them is as good as another hash."""
    out = []
    for i in range(n):
        z = (i + 1 + 1000 * salt) * 0x9E3779B97F4A7C15 % (1 << 64)
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        z = ((i << 64) // n) ^ (z >> 8)
        out.append(z - (1 << 64) if z >= 1 << 63 else z)
    return out


def _sketch(hashed: str, n: int, salt: int) -> Column:
    """The smallest of a column's hashes under each of n masks: a value is hashed once, whatever the sketch's size."""
    return F.array(*[F.min(F.col(hashed).bitwiseXOR(F.lit(m))) for m in _masks(n, salt)])


def fields_of(records: DataFrame) -> DataFrame:
    """One row for each field of each readable body, with the value as a variant; a null value has the type 'null'.

    A body is readable if it is one JSON object; broken, null and other bodies give nothing.
    """
    body = F.try_parse_json("body").try_cast("map<string,variant>")
    one = records.select(*FILE, F.explode(body).alias("field", "value"))
    return one.withColumn("kind", _kind_of(F.col("value")))


def _leaves(kind: Column, text: Column) -> Column:
    """Scalars inside a value: the value itself, or those of an object or array, keys left out."""
    inner = F.transform(
        F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', ""), F.lit(r'("(?:[^"\\]|\\.)*"|[^\s"\[\]{},]+)'), F.lit(1)),
        lambda x: F.btrim(x, F.lit('"')),
    )
    return F.when(kind == "null", F.array().cast("array<string>")).when(kind.isin("object", "array"), inner).otherwise(F.array(text))


def _token(leaf: Column) -> tuple[Column, Column, Column]:
    """A scalar's normal form, its shape and its number: the same datum gives the same whatever its JSON type.

    Units and trailing zeros go, booleans read yes and no, and instants in any notation are one token.
    """
    s = F.lower(F.trim(leaf))
    number = F.regexp_extract(s, r"^([+-]?\d+(?:\.\d+)?)\s*[a-z%]{0,4}$", 1).try_cast("double")
    is_time = s.rlike(r"^\d{4}-\d{2}-\d{2}[t ]\d{2}:") | number.between(1.0e9, 4.0e9) | number.between(1.0e12, 4.0e12)
    token = (
        F.when(is_time, "@time")
        .when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string")))
        .when(s.isin("true", "yes"), "yes")
        .when(s.isin("false", "no"), "no")
        .otherwise(s)
    )
    shape = F.when(token.rlike("^(@|#|yes$|no$)"), F.lit(None)).otherwise(F.regexp_replace(F.regexp_replace(s, "[0-9]", "9"), "[a-f]", "9"))
    return token, shape, F.when(~is_time, number)


def profiles(records: DataFrame) -> DataFrame:
    """One row for each field of each file, and one with a null field for the file itself."""
    rows = fields_of(records).select(*FILE, "field", "kind", F.explode_outer(_leaves(F.col("kind"), F.col("value").cast("string"))).alias("leaf"))
    token, shape, number = _token(F.col("leaf"))
    rows = rows.select(*FILE, "field", "kind", token.alias("token"), shape.alias("shape"), number.alias("number"))
    hashed = {n: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for n, c in (("value_hash", "token"), ("shape_hash", "shape"))}
    rows = rows.withColumns(hashed)
    zeros = F.when(F.col("number") % 1 == 0, F.length(F.regexp_extract(F.col("number").cast("decimal(38,0)").cast("string"), "(0*)$", 1))).otherwise(0)
    profile = rows.groupBy(*FILE, "field").agg(
        F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))).alias("kinds"),
        F.count("token").alias("n"),
        F.approx_count_distinct("token").alias("distinct"),
        F.count("number").alias("numbers"),
        F.percentile_approx("number", F.array(F.lit(0.1), F.lit(0.9)), F.lit(1000)).alias("quantiles"),
        F.min(F.when(F.col("number").isNotNull(), zeros)).alias("zeros"),
        _sketch("value_hash", VALUE_HASHES, 1).alias("values"),
        _sketch("shape_hash", SHAPE_HASHES, 2).alias("shapes"),
    )
    files = records.groupBy(*FILE).agg(F.min("file_name").alias("file_name"))
    return profile.join(files, FILE, "right")


def name_similarity(a: str, b: str) -> float:
    """Share of common letter pairs of two names, case and punctuation ignored."""
    x, y = ("".join(c for c in s.lower() if c.isalnum()) for s in (a, b))
    p, q = {x[i : i + 2] for i in range(len(x) - 1)}, {y[i : i + 2] for i in range(len(y) - 1)}
    return 2 * len(p & q) / max(1, len(p) + len(q))


def data_similarity(a: dict, b: dict) -> float:
    """0 to 1: the sketches' overlap of values, or of shapes and ranges where values hardly repeat."""
    if not a["n"] or not b["n"]:
        return 0.0
    share = float(np.mean(a["values"] == b["values"]))
    small, large = sorted((max(1, a["distinct"]), max(1, b["distinct"])))
    overlap = min(1.0, share / (1 + share) * (small + large) / small)
    unique = min(a["distinct"] / a["n"], b["distinct"] / b["n"]) > 0.6
    numeric = [x["numbers"] / x["n"] > 0.9 for x in (a, b)]
    alike = 0.0
    if all(numeric) and unique:
        (l1, h1), (l2, h2) = a["quantiles"], b["quantiles"]
        inside = min(h1, h2) - max(l1, l2)
        if a["zeros"] == b["zeros"] and a["zeros"] >= 1 and inside > 0:
            alike = 0.5 + 0.4 * inside / max(h1, h2, 1e-9)
        elif inside > 0 and share > 0:
            alike = 0.3 + 0.3 * inside / max(1e-9, max(h1, h2) - min(l1, l2))
    elif not any(numeric) and unique:
        both = [(p, q) for p, q in zip(a["shapes"], b["shapes"]) if p is not None and q is not None]
        alike = 0.8 * float(np.mean([p == q for p, q in both])) if len(both) == SHAPE_HASHES else 0.0
    return max(overlap, alike)


def look_similarity(a: dict, b: dict) -> float:
    """0 to 1: how alike two fields look that need not share a value, as ids of different producers: by the range and the
    roundness of numbers, or by the shapes of texts."""
    if not a["n"] or not b["n"]:
        return 0.0
    numeric = [x["numbers"] / x["n"] > 0.9 for x in (a, b)]
    if all(numeric) and a["zeros"] == b["zeros"]:
        (l1, h1), (l2, h2) = a["quantiles"], b["quantiles"]
        return max(0.0, min(h1, h2) - max(l1, l2)) / max(1e-9, max(h1, h2) - min(l1, l2))
    both = [(p, q) for p, q in zip(a["shapes"], b["shapes"]) if p is not None and q is not None]
    return float(np.mean([p == q for p, q in both])) if both and not any(numeric) else 0.0


def less_round(a: dict, b: dict) -> bool:
    """Whether a holds numbers that are less round than any of b."""
    return all(x["n"] and x["numbers"] / x["n"] > 0.9 for x in (a, b)) and a["zeros"] < b["zeros"]


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching by shortest augmenting paths; pairs of weight 0 stay unmatched."""
    n = max(weight.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : weight.shape[0] + 1, 1 : weight.shape[1] + 1] = -weight
    u, v, owner, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            slack = cost[owner[j0]] - u[owner[j0]] - v
            slack[used] = np.inf
            better = slack < least
            least[better], way[better] = slack[better], j0
            j1 = int(np.argmin(np.where(used | (np.arange(n + 1) == 0), np.inf, least)))
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, weight.shape[1] + 1)]
    return [(i, j) for i, j in pairs if 0 <= i < weight.shape[0] and weight[i, j] > 0]


def _merged_profile(profiles: list[dict]) -> dict:
    """The profile of a field over several files: sketches keep their minima, the number of distinct values follows from
    how small those are."""
    held = [p for p in profiles if p["n"]]
    if not held:
        return {"n": 0, "distinct": 0, "numbers": 0, "quantiles": None, "zeros": None, "values": None, "shapes": None}
    least = lambda k: [min((p[k][i] for p in held if p[k][i] is not None), default=None) for i in range(len(held[0][k]))]
    values, n = least("values"), int(sum(p["n"] for p in held))
    known = [v for v in values if v is not None]
    spread = sum((int(v) + (1 << 63)) / float(1 << 64) for v in known)
    # one file's count is a lower bound; the sketch says how much larger the union is
    distinct = int(max(max(p["distinct"] for p in held), min(n, len(known) / max(spread, 1e-300))))
    quantiles = [list(p["quantiles"]) for p in held if p["quantiles"] is not None]
    zeros = [p["zeros"] for p in held if p["zeros"] is not None and p["zeros"] == p["zeros"]]
    return {
        "n": n,
        "distinct": distinct,
        "numbers": int(sum(p["numbers"] for p in held)),
        "quantiles": [float(min(q[0] for q in quantiles)), float(max(q[1] for q in quantiles))] if quantiles else None,
        "zeros": int(min(zeros)) if zeros else None,
        "values": values,
        "shapes": least("shapes"),
    }


_PROFILE = "n bigint, distinct bigint, numbers bigint, quantiles array<double>, zeros int, values array<bigint>, shapes array<bigint>"
_PROFILE_FIELDS = [f.split()[0] for f in _PROFILE.split(", ")]


def _merged_profiles(profiles: DataFrame, *groups: str) -> DataFrame:
    """As _merged_profile, for each group over all its rows: minima, maxima and sums, so that no task holds a group."""
    least = lambda k, n: F.array(*[F.min(F.col(k)[i]) for i in range(n)]).alias(k)
    merged = profiles.filter("n > 0").groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.max("distinct").alias("distinct"),
        F.sum("numbers").alias("numbers"),
        F.array(F.min(F.col("quantiles")[0]), F.max(F.col("quantiles")[1])).alias("quantiles"),
        F.min("zeros").alias("zeros"),
        least("values", VALUE_HASHES),
        least("shapes", SHAPE_HASHES),
    )
    known = F.array_compact("values")
    spread = F.aggregate(known, F.lit(0.0), lambda total, v: total + (v.cast("double") + 2.0**63) / 2.0**64)
    # one lineage's count is a lower bound; the sketch says how much larger the union is
    union = F.least(F.col("n").cast("double"), F.size(known) / F.greatest(spread, F.lit(1e-300))).cast("bigint")
    merged = merged.withColumn("distinct", F.greatest("distinct", union))
    return merged.withColumn("quantiles", F.when(F.col("quantiles")[0].isNotNull(), F.col("quantiles")))


_CHANGE_FIELDS = ["feed", "producer", "what", "file_no", "file_name", "kind", "old_field", "new_field"]


def _versions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Changes, field lineages and the lineages' profiles of one producer's files: what='change', 'lineage', 'profile'."""
    out, before, lineage, seen = [], None, {}, {}
    head = (pdf["feed"].iloc[0], pdf["producer"].iloc[0])
    for number, rows in pdf.sort_values("file_no").groupby("file_no", sort=True):
        here = {r["field"]: r for r in rows.to_dict("records") if isinstance(r["field"], str)}
        name = rows["file_name"].iloc[0]
        renamed: dict[str, str] = {}
        if before is not None:
            gone, fresh = sorted(set(before) - set(here)), sorted(set(here) - set(before))
            if gone and fresh:
                renamed = {fresh[j]: gone[i] for i, j in _matched({a: before[a] for a in gone}, {b: here[b] for b in fresh})}
            out += [("change", number, name, "renamed", a, b) for b, a in renamed.items()]
            out += [("change", number, name, "removed", a, "") for a in gone if a not in renamed.values()]
            out += [("change", number, name, "added", "", b) for b in fresh if b not in renamed]
            for b, row in here.items():
                old = before.get(renamed.get(b, b))
                if old is not None and len(old["kinds"]) and len(row["kinds"]) and set(old["kinds"]) != set(row["kinds"]):
                    out.append(("change", number, name, "type", renamed.get(b, b), b))
        lineage = {b: lineage.get(renamed.get(b, b), f"{b}@{number}") for b in here}
        for b, root in lineage.items():
            out.append(("lineage", number, name, root, "", b))
            seen.setdefault(root, []).append(here[b] | {"file_no": number})
        before = here
    out = [(*head, *r, None, *[None] * len(_PROFILE_FIELDS)) for r in out]
    for root, profiles in seen.items():
        merged = _merged_profile(profiles)
        out.append((*head, "profile", 0, None, root, "", "", [int(p["file_no"]) for p in profiles], *[merged[k] for k in _PROFILE_FIELDS]))
    frame = pd.DataFrame(out, columns=["feed", "producer", "what", "file_no", "file_name", "kind", "old_field", "new_field", "files", *_PROFILE_FIELDS])
    return frame.astype({k: "Int64" for k in ("n", "distinct", "numbers", "zeros")})


def _matched(left: dict[str, dict], right: dict[str, dict], similarity=data_similarity) -> list[tuple[int, int]]:
    """Maximum-weight matching of profiles by their data; names only break ties."""
    data = np.array([[similarity(a, b) for b in right.values()] for a in left.values()])
    ties = np.array([[name_similarity(a.split("@")[0], b.split("@")[0]) for b in right] for a in left])
    return best_matching(np.where(data >= SAME_DATA, data + 0.1 * ties, 0.0))


def versions(records: DataFrame) -> DataFrame:
    """(feed, producer, what, file_no, file_name, kind, old_field, new_field).

    what='change': kind is added, removed, renamed or type; what='lineage': kind is the lineage to which new_field of
    that file belongs. The preceding file is the one with the next smaller file_no that exists. Fields of which one
    file has only nulls have no type there and report no type change. A file without a readable body has no fields.
    Repeated and late lines change nothing. Rows with a null feed, producer or file_no are left out; an empty table
    gives an empty table.
    """
    known = records.select(*FILE, "file_name", "body").filter("feed is not null and producer is not null and file_no is not null")
    schema = "feed string, producer string, what string, file_no int, file_name string, kind string, old_field string, new_field string"
    return profiles(known).groupBy("feed", "producer").applyInPandas(lambda pdf: _versions(pdf)[_CHANGE_FIELDS], schema)


def _lineages(records: DataFrame) -> DataFrame:
    """As versions, with the merged profile of every lineage (what='profile')."""
    known = records.select(*FILE, "file_name", "body").filter("feed is not null and producer is not null and file_no is not null")
    schema = "feed string, producer string, what string, file_no int, file_name string, kind string, old_field string, new_field string, files array<int>, " + _PROFILE
    return profiles(known).groupBy("feed", "producer").applyInPandas(_versions, schema)


def changes(records: DataFrame) -> DataFrame:
    """(feed, file_name, change_kind, old_field, new_field): one row for each change between neighbouring files."""
    return versions(records).filter("what = 'change'").select("feed", "file_name", F.col("kind").alias("change_kind"), "old_field", "new_field")


#: The fields of the unified tables with their types, by feed.
TARGETS = {
    "sample_logs": {"event_id": "string", "timestamp": "string", "case_id": "string", "activity": "string", "resource": "string", "amount": "double"},
    "sample_agent_logs": {"timestamp": "string", "task_id": "string", "activity": "string", "agent_name": "string", "tool_used": "string", "status": "string"},
}


def assignments(records: DataFrame, targets: dict[str, dict[str, str]] = TARGETS) -> DataFrame:
    """(feed, producer, file_no, field, target): which target field every field of every file stands for.

    A lineage that bears a target's name anywhere is that target. The others of a producer are matched by their data
    with the targets that the producer lacks, as these look where they bear their name in other producers; what other
    names such lineages bear counts too. One field of a file at most stands for a target.
    """
    spark = records.sparkSession
    names = spark.createDataFrame([(f, t) for f, ts in targets.items() for t in ts], "feed string, target string")
    every = cut(_lineages(records))
    lineage = every.filter("what = 'lineage'").select("feed", "producer", "file_no", F.col("kind").alias("lineage"), F.col("new_field").alias("field"))
    own = lineage.join(names, (lineage["feed"] == names["feed"]) & (lineage["field"] == names["target"])).groupBy(lineage["feed"], "producer", "lineage").agg(F.min("target").alias("direct"))
    known = lineage.join(own, ["feed", "producer", "lineage"], "left")
    votes = known.filter("direct is not null").groupBy("feed", "field", F.col("direct").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    voted = votes.groupBy("feed", "field").agg(F.max_by("t", F.struct("n", "t")).alias("voted"))
    asked = known.join(voted, ["feed", "field"], "left").groupBy("feed", "producer", "lineage").agg(F.max("direct").alias("direct"), F.max("voted").alias("voted"))
    looks = every.filter("what = 'profile'").select("feed", "producer", F.col("kind").alias("lineage"), "files", *_PROFILE_FIELDS).join(asked, ["feed", "producer", "lineage"])

    # one row for each target, of all lineages that bear its name
    typical = _merged_profiles(looks.filter("direct is not null"), "feed", "direct").withColumnRenamed("direct", "target")
    typical = names.join(typical, ["feed", "target"], "left").groupBy("feed").agg(F.collect_list(F.struct("target", *_PROFILE_FIELDS)).alias("typical"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r["lineage"]: r for r in pdf.to_dict("records")}
        typical = {t["target"]: dict(t) for t in pdf["typical"].iloc[0]}
        used: dict[str, set] = {t: set() for t in typical}  # the files in which a target has its field
        out: list[tuple] = []

        def take(lineage: str, target: str, guess: bool) -> None:
            out.append((lineage, target, guess))
            used[target] |= set(rows[lineage]["files"])

        for lineage, r in rows.items():
            if isinstance(r["direct"], str):
                take(lineage, r["direct"], False)
        left = {lineage: r for lineage, r in rows.items() if not isinstance(r["direct"], str)}
        fits = lambda r, t: used[t].isdisjoint(r["files"])
        for lineage, r in sorted(left.items()):
            if isinstance(r["voted"], str) and fits(r, r["voted"]):
                take(lineage, r["voted"], True)
                del left[lineage]
        for similarity in (data_similarity, look_similarity):
            while left:  # a target may take several lineages, one after another, in files that lie apart
                known = {t: p for t, p in typical.items() if p["n"] is not None and p["n"]}
                # where a target has many more values than a lineage, one that both have looks like an overlap
                weigh = lambda a, b: similarity(a, b) if fits(a, b["target"]) and not less_round(a, b) else 0.0  # noqa: E731, B023
                pairs = _matched(left, known, weigh) if known else []
                if not pairs:
                    break
                ls, ts = list(left), list(known)
                for i, j in pairs:
                    take(ls[i], ts[j], True)
                    del left[ls[i]]
        frame = pd.DataFrame(out, columns=["lineage", "target", "guess"], dtype=object)
        frame.insert(0, "producer", pdf["producer"].iloc[0])
        frame.insert(0, "feed", pdf["feed"].iloc[0])
        return frame

    # a producer's lineages are a few rows; the targets' looks go along in each
    target = looks.join(typical, "feed").groupBy("feed", "producer").applyInPandas(assign, "feed string, producer string, lineage string, target string, guess boolean")
    return lineage.join(target, ["feed", "producer", "lineage"]).groupBy("feed", "producer", "file_no", "target").agg(F.min_by("field", F.struct("guess", "lineage")).alias("field"))


def _kind_of(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (name == "VOID"), "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def unified(records: DataFrame, feed: str, targets: dict[str, dict[str, str]] = TARGETS) -> DataFrame:
    """One row for each readable record of a feed: record_id, producer, file_name, line_no, the target fields with their
    types, and ``extras``, a map from field name to variant.

    A target of type string takes scalars as text, a numeric one numbers and text that is a number, with or without a
    unit; an object gives its first scalar, an array its scalars joined by commas. Nothing is dropped: extras holds
    every field that no target stands for, and also every field whose value its target does not hold as it was
    (objects, arrays, text read as a number). Null values need no extras where a target stands for them. Fields that a
    file lacks are null; broken records give no row; repeated records stay repeated.
    """
    own = records.filter(F.col("feed") == feed)
    body = F.try_parse_json("body").try_cast("map<string,variant>")
    rows = own.select("record_id", "producer", "file_no", "file_name", "line_no", body.alias("body")).filter("body is not null")
    maps = assignments(records, targets).filter(F.col("feed") == feed).groupBy("producer", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("target", "field"))).alias("fields"))
    # a file's assignments are one small row; a producer with many rows is split by AQE, as the other side has one
    rows = rows.join(maps, ["producer", "file_no"], "left")

    def value(target: str) -> Column:
        return F.when(F.col("fields")[target].isNotNull(), F.col("body")[F.col("fields")[target]])

    def typed(target: str, kind: str) -> Column:
        v, of = value(target), _kind_of(value(target))
        inside = _leaves(of, v.cast("string"))
        if kind != "string":
            text = F.when(of.isin("object", "array"), F.try_element_at(inside, F.lit(1))).otherwise(v.cast("string"))
            number = F.regexp_extract(F.lower(F.trim(text)), r"^([+-]?\d+(?:\.\d+)?)\s*[a-z%]{0,4}$", 1)
            return F.coalesce(F.try_variant_get(v, "$", kind), number.try_cast(kind)) if kind != "boolean" else F.try_variant_get(v, "$", kind)
        return F.when(of == "null", F.lit(None)).when(of == "object", F.try_element_at(inside, F.lit(1))).when(of == "array", F.array_join(inside, ",")).otherwise(v.cast("string"))

    def held(target: str, kind: str) -> Column:
        """The name of the field that a target stands for and holds as it was."""
        whole = ("null", "string", "number", "boolean") if kind == "string" else ("null", "boolean") if kind == "boolean" else ("null", "number")
        return F.when(_kind_of(value(target)).isin(*whole), F.col("fields")[target])

    kept = F.array_compact(F.array(*[held(t, k) for t, k in targets[feed].items()]))
    rows = rows.withColumn("kept", kept)
    return rows.select(
        "record_id", "producer", "file_name", "line_no",
        *[typed(t, k).alias(t) for t, k in targets[feed].items()],
        F.map_filter("body", lambda k, _: ~F.array_contains("kept", k)).alias("extras"),
    )
