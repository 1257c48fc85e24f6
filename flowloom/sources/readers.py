"""Scans: XES, CSV, JSON, BPMN, PNML, YAML, JDBC, all through Spark's own sources where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_ATTRIBUTE = ArrayType(StructType([StructField("_key", StringType()), StructField("_value", StringType())]))
_KINDS = ("string", "date", "int", "float", "boolean")


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, event_no, activity, us, lifecycle, attrs) of an XES file, one row an event.

    Attributes of every simple type are kept in a map of strings. A missing timestamp or name is null.
    """
    event = StructType([StructField(k, _ATTRIBUTE) for k in _KINDS])
    trace = StructType([*[StructField(k, _ATTRIBUTE) for k in _KINDS], StructField("event", ArrayType(event))])
    raw = spark.read.format("xml").option("rowTag", "trace").schema(trace).load(path)

    def attributes(prefix: str):
        every = F.concat(*[F.coalesce(F.col(f"{prefix}{k}"), F.array().cast(_ATTRIBUTE.simpleString())) for k in _KINDS])
        return F.map_from_entries(F.transform(every, lambda x: F.struct(x["_key"], x["_value"])))

    rows = raw.select(attributes("").alias("t"), F.posexplode("event").alias("n", "e"))
    rows = rows.select(F.col("t").getItem("concept:name").alias("case_id"), (F.col("n") + 1).alias("event_no"), attributes("e.").alias("attrs"))
    return rows.select("case_id", "event_no", F.col("attrs").getItem("concept:name").alias("activity"), F.unix_micros(F.try_to_timestamp(F.col("attrs").getItem("time:timestamp"))).alias("us"), F.col("attrs").getItem("lifecycle:transition").alias("lifecycle"), "attrs")


def read_csv(spark: SparkSession, path: str, schema: str, null: str = "\\N") -> DataFrame:
    """A CSV file with a header and a given schema; broken values are null, and so is the text ``null``."""
    return spark.read.schema(schema).options(escape='"', multiLine=True, nullValue=null).csv(path, header=True, mode="PERMISSIVE")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON array or object over several lines, or one object a line in a folder of files."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_bpmn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, flows) of a BPMN file: nodes have id, type and name, flows have source and target."""
    kinds = ("startEvent", "endEvent", "task", "userTask", "serviceTask", "exclusiveGateway", "parallelGateway", "inclusiveGateway")
    one = StructType([StructField("_id", StringType()), StructField("_name", StringType())])
    flow = StructType([StructField("_sourceRef", StringType()), StructField("_targetRef", StringType())])
    nodes = None
    for k in kinds:
        part = spark.read.format("xml").option("rowTag", f"bpmn:{k}").schema(one).load(path)
        part = part.select(F.col("_id").alias("id"), F.lit(k).alias("type"), F.col("_name").alias("name"))
        nodes = part if nodes is None else nodes.unionByName(part)
    flows = spark.read.format("xml").option("rowTag", "bpmn:sequenceFlow").schema(flow).load(path)
    return nodes, flows.select(F.col("_sourceRef").alias("source"), F.col("_targetRef").alias("target"))


def read_bpmn_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(id, direction, name, value) of the input and output parameters of all kinds of tasks in a BPMN file."""
    parameter = ArrayType(StructType([StructField("_name", StringType()), StructField("_VALUE", StringType())]))
    inout = StructType([StructField("camunda:inputParameter", parameter), StructField("camunda:outputParameter", parameter)])
    one = StructType([StructField("_id", StringType()), StructField("bpmn:extensionElements", StructType([StructField("camunda:inputOutput", inout)]))])
    out = None
    for k in ("task", "userTask", "serviceTask"):
        rows = spark.read.format("xml").option("rowTag", f"bpmn:{k}").schema(one).load(path)
        io = F.col("`bpmn:extensionElements`.`camunda:inputOutput`")
        for direction in ("input", "output"):
            part = rows.select(F.col("_id").alias("id"), F.lit(direction).alias("direction"), F.explode(io[f"camunda:{direction}Parameter"]).alias("p"))
            part = part.select("id", "direction", F.col("p._name").alias("name"), F.col("p._VALUE").alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


#: How stores name the parts of an edge: start, type and end, each end with a label and an id.
EDGE_LAYOUTS = {
    "json": ("start.label", "start.id", "type", "end.label", "end.id"),
    "jdbc": ("src_label", "src", "label", "dst_label", "dst"),
    "org.neo4j.spark.DataSource": ("`<source.labels>`[0]", "`source.id`", "`<rel.type>`", "`<target.labels>`[0]", "`target.id`"),
    "org.apache.spark.sql.cassandra": ("src_label", "src", "label", "dst_label", "dst"),
}


def read_edges(spark: SparkSession, format: str, options: dict[str, str]) -> DataFrame:
    """(src_label, src, label, dst_label, dst) of a store's relationships, by the connector's format and options.

    The parts are taken by the layout of the connector; filters on them go down with its scan. JDBC scans are split by
    the options partitionColumn, lowerBound, upperBound and numPartitions. A format without a layout is an error.
    """
    if format not in EDGE_LAYOUTS:
        raise ValueError(f"no edge layout for {format}")
    raw = spark.read.format(format).options(**options).load()
    names = ("src_label", "src", "label", "dst_label", "dst")
    return raw.select(*[F.expr(e).cast("string").alias(n) for e, n in zip(EDGE_LAYOUTS[format], names)])


def read_pnml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, transitions, arcs) of a PNML file."""
    named = StructType([StructField("_id", StringType()), StructField("name", StructType([StructField("text", StringType())]))])
    arc = StructType([StructField("_source", StringType()), StructField("_target", StringType())])

    def rows(tag: str, schema: StructType) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    places = rows("place", named).select(F.col("_id").alias("id"))
    transitions = rows("transition", named).select(F.col("_id").alias("id"), F.col("name.text").alias("label"))
    return places, transitions, rows("arc", arc).select(F.col("_source").alias("source"), F.col("_target").alias("target"))


def read_yaml(path: str) -> dict:
    """A job's configuration; YAML must be installed."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def read_table(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    """A table of a store by configuration: jdbc and other connectors by their format name, files by path.

    Graph and document stores are read as edge tables through their connector's format; filters go down with the scan.
    """
    formats = {"database": "jdbc", "file_upload": options.get("file_format", "parquet"), "streaming": "rate"}
    reader = spark.readStream if kind == "streaming" else spark.read
    return reader.format(options.get("format", formats.get(kind, kind))).options(**{k: v for k, v in options.items() if k not in ("format", "file_format")}).load()
