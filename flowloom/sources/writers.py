"""Sinks: XES, CSV, JSON, snapshots, PNML and BPMN text, versioned tables."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.conformance import Net


def write_xes(log: DataFrame, path: str) -> None:
    """K1: an XES log of case_id, activity and us, one trace a case, events in order."""

    def attribute(key: str, value) -> object:
        return F.array(F.struct(F.lit(key).alias("_key"), value.alias("_value")))

    event = F.struct(attribute("concept:name", F.col("activity")).alias("string"), attribute("time:timestamp", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).alias("date"))
    traces = log.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", event.alias("e")))), lambda x: x["e"]).alias("event"))
    traces.select(attribute("concept:name", F.col("case_id").cast("string")).alias("string"), "event").write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K2: blanks, quotation marks and line ends are kept; null is written \\N, so that it differs from an empty text."""
    df.write.mode("overwrite").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', nullValue="\\N").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """K3, K4."""
    df.write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key a Parquet table lacks; returns how many. The first call makes the table."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_version(df: DataFrame, path: str, version: int) -> None:
    """One version of a table; an existing version is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest by default."""
    every = spark.read.parquet(path)
    at = version if version is not None else every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == at).drop("version")


def snapshot(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """One JSON document of the top variants and the metrics' only row. variants are limited by the caller."""
    v = variants.agg(F.array_sort(F.collect_list(F.struct("variant", "frequency"))).alias("variants"))
    return v.crossJoin(metrics.select(F.struct(*metrics.columns).alias("metrics"))).select(F.to_json(F.struct("variants", "metrics")).alias("snapshot"))


def pnml(net: Net) -> str:
    """K5: a net as PNML text."""
    places = sorted({x for _, _, pre, post in net.transitions for x in pre | post} | net.initial | net.final)
    out = ['<pnml><net id="net" type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel"><page id="page">']
    for p in places:
        mark = "<initialMarking><text>1</text></initialMarking>" if p in net.initial else ""
        out.append(f"<place id={quoteattr(p)}>{mark}</place>")
    for i, label, pre, post in net.transitions:
        name = f"<name><text>{quoteattr(label)[1:-1]}</text></name>" if label is not None else ""
        out.append(f"<transition id={quoteattr(i)}>{name}</transition>")
        out += [f"<arc source={quoteattr(p)} target={quoteattr(i)}></arc>" for p in sorted(pre)] + [f"<arc source={quoteattr(i)} target={quoteattr(p)}></arc>" for p in sorted(post)]
    return "\n".join([*out, "</page></net></pnml>"])


def bpmn(edges: list[tuple[str, str]], starts: set[str] | None = None, stops: set[str] | None = None) -> str:
    """A directly-follows model as BPMN text: tasks, a start and an end event, sequence flows.

    Without ``starts`` and ``stops`` the model starts at its sources and ends at its sinks.
    """
    nodes = sorted({n for e in edges for n in e} | (starts or set()) | (stops or set()))
    first = {n for n in nodes if not any(b == n for _, b in edges)} if starts is None else starts
    last = {n for n in nodes if not any(a == n for a, _ in edges)} if stops is None else stops
    flows = sorted(set(edges)) + [("start", n) for n in sorted(first)] + [(n, "end") for n in sorted(last)]
    out = ['<bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL"><bpmn:process id="process">', '<bpmn:startEvent id="start"></bpmn:startEvent>', '<bpmn:endEvent id="end"></bpmn:endEvent>']
    out += [f"<bpmn:task id={quoteattr(n)} name={quoteattr(n)}></bpmn:task>" for n in nodes]
    out += [f"<bpmn:sequenceFlow id={quoteattr(f'f{i}')} sourceRef={quoteattr(a)} targetRef={quoteattr(b)}></bpmn:sequenceFlow>" for i, (a, b) in enumerate(flows)]
    return "\n".join([*out, "</bpmn:process></bpmn:definitions>"])
