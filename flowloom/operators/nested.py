"""Deeply nested records as related flat tables: structural variants, typed subtype tables, one supertype.

A bottom-up tree automaton reads every record: the state of a node follows from the states of its children. It is the
kind that its child array gives it ('leaf' for null, 'empty' for no elements, 'gappy' for elements of which some are
null, 'branch' otherwise), the kinds of its children, and the fields that it has. Every kind is routed to its own typed
table, once; what all share, with the link upward, is the supertype. The depth comes from the schema, so the whole
flattening is one expression and one explode over the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from flowloom.session import table_path

KINDS = ("leaf", "empty", "gappy", "branch")
_COMMON = ("node_path", "parent_id", "node_id", "depth")


@dataclass(frozen=True)
class Flattened:
    """``subtypes``: per kind a table of its rows with its own typed columns (own_..). All have the columns ``common``."""

    subtypes: dict[str, DataFrame]
    common: list[str]

    @property
    def nodes(self) -> DataFrame:
        """The common supertype: one row a node, from the subtype tables."""
        return reduce(DataFrame.unionByName, [t.select(*self.common, "state") for t in self.subtypes.values()])


def _deeper(kind: StructType, children: str) -> ArrayType | None:
    own = next((f.dataType for f in kind.fields if f.name == children), None)
    return own if isinstance(own, ArrayType) and isinstance(own.elementType, StructType) else None


def _own_fields(kind: ArrayType, children: str) -> dict[str, DataType]:
    """The fields of all levels, without the child arrays; one that has several types is a string."""
    out: dict[str, DataType] = {}
    while kind is not None:
        for f in kind.elementType.fields:
            if f.name != children:
                out[f.name] = f.dataType if out.get(f.name, f.dataType) == f.dataType else StringType()
        kind = _deeper(kind.elementType, children)
    return out


def _state(node: Column, kind: StructType, children: str) -> Column:
    """The automaton's state of a node, 'kind[kinds of the children]:fields present', from its children's states."""
    fields = [f.name for f in kind.fields if f.name != children]
    present = F.concat(F.lit(":"), *[F.when(node[f].isNotNull(), "1").otherwise("0") for f in fields])
    deeper = _deeper(kind, children)
    if deeper is None:
        return F.concat(F.lit("leaf[]"), present)
    states = F.transform(node[children], lambda c: F.when(c.isNull(), "null[").otherwise(_state(c, deeper.elementType, children)))
    below = F.array_sort(F.array_distinct(F.transform(states, lambda s: F.substring_index(s, "[", 1))))
    own = F.when(below.isNull(), "leaf").when(F.size(below) == 0, "empty").when(F.array_contains(below, "null"), "gappy").otherwise("branch")
    return F.concat(own, F.lit("["), F.coalesce(F.array_join(below, "|"), F.lit("")), F.lit("]"), present)


def _below(elements: Column, kind: ArrayType, children: str, key: str, parent: Column, path: Column, level: int, own_fields: dict[str, DataType]) -> Column:
    """array<struct> of all nodes at and under the elements of one child array."""
    here = {f.name for f in kind.elementType.fields}
    deeper = _deeper(kind.elementType, children)

    def node(x: Column, i: Column) -> Column:
        at = F.concat(path, (i + 1).cast("string"))
        own = F.struct(
            at.alias("node_path"),
            F.coalesce(parent, F.lit("")).alias("parent_id"),
            F.coalesce(x[key].cast("string"), F.lit("")).alias("node_id"),
            F.lit(level).alias("depth"),
            _state(x, kind.elementType, children).alias("state"),
            F.struct(*[(x[f] if f in here else F.lit(None)).cast(t).alias(f) for f, t in own_fields.items()]).alias("own"),
            (F.size(F.coalesce(x[children], F.array())) if deeper else F.lit(0)).alias("n_children"),
        )
        if deeper is None:
            return F.when(x.isNotNull(), F.array(own))
        rest = _below(x[children], deeper, children, key, x[key].cast("string"), F.concat(at, F.lit(".")), level + 1, own_fields)
        return F.when(x.isNotNull(), F.concat(F.array(own), rest))

    every = F.transform(F.coalesce(elements, F.array().cast(kind.simpleString())), node)
    return F.flatten(F.filter(every, lambda a: a.isNotNull()))


def flatten(df: DataFrame, row: str, key: str, children: str) -> Flattened:
    """Flattens ``children``, an array of structs that hold arrays of the same name, to any depth the schema has.

    ``row`` identifies a top-level record, ``key`` names the id field of records and nodes. Paths count from 1 and count
    null elements too, but null elements give no node and nothing under them; null and empty arrays give nothing.
    Missing ids are ''. Repeated top-level records stay repeated, as they have their own ``row``. Other columns of the
    table are ignored. A record's nodes leave its task as single rows: a very wide record is never gathered again. The
    input is read once; the nodes are written to one folder for each kind, and a subtype table reads its own folder.
    """
    spark, kind = df.sparkSession, df.schema[children].dataType
    own = _own_fields(kind, children)
    nodes = df.select(F.col(row), F.explode(_below(F.col(children), kind, children, key, F.col(key).cast("string"), F.lit(""), 2, own)).alias("n")).select(row, "n.*")
    at = table_path(spark)
    routed = nodes.withColumn("kind", F.substring_index("state", "[", 1))
    routed.write.partitionBy("kind").parquet(at)
    written = spark.read.schema(routed.schema).parquet(at)
    extra = {"gappy": ["n_children"], "branch": ["n_children"]}
    subtypes = {k: written.filter(F.col("kind") == k).select(row, *_COMMON, "state", *[F.col("own")[f].alias(f"own_{f}") for f in own], *extra.get(k, [])) for k in KINDS}
    return Flattened(subtypes, [row, *_COMMON])
