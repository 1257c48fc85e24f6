"""Structured Streaming: windows under watermarks, in-progress matching and incremental stitching."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.operators import graph
from flowloom.session import ensure_checkpoint_dir


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is now and give its result: the last complete table, or all appended rows."""
    spark, at = stream.sparkSession, _folder(stream.sparkSession)

    def keep(df: DataFrame, number: int) -> None:
        # a batch that runs again replaces its own part
        df.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not _exists(spark, f"{at}/out"):
        return spark.createDataFrame([], stream.schema)
    parts = _parts(spark, f"{at}/out", "batch=")
    return spark.read.schema(stream.schema).parquet(*[f"{at}/out/batch={n}" for n in (parts[-1:] if mode == "complete" else parts)])


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, at: str) -> bool:
    fs, path = _path(spark, at)
    return fs.exists(path)


def _parts(spark: SparkSession, at: str, prefix: str = "") -> list[int]:
    """The numbers of the entries of a folder that are called prefix and number, in order."""
    fs, path = _path(spark, at)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Events by activity and tumbling window, with a watermark for late ones."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "activity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "activity", "n")


def session_counts(stream: DataFrame, ts: str, entity: str, gap: str, late: str) -> DataFrame:
    """Sessions of an entity that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), entity, "n")


def trie(variants: dict[str, list[str]], repeatable: set[str] = frozenset()) -> dict:
    """A trie as {"next": {node: {activity: node}}, "passing": {node: [variants]}, "label": {node: activity}}; node 0 is the root."""
    nxt, passing, label = {0: {}}, {0: sorted(variants)}, {0: None}
    for name, steps in sorted(variants.items()):
        node = 0
        for a in steps:
            if a not in nxt[node]:
                new = len(nxt)
                nxt[node][a], nxt[new], passing[new], label[new] = new, {}, [], a
            node = nxt[node][a]
            passing[node].append(name)
    return {"next": nxt, "passing": passing, "label": label, "repeatable": sorted(repeatable)}


def advance(t: dict, node: int, activity: str) -> int:
    """The next node; a repeatable node stays on its own label; without a match the case returns to the root."""
    following = t["next"][node]
    if activity in following:
        return following[activity]
    return node if activity == t["label"][node] and activity in t["repeatable"] else 0


def match_in_progress(stream: DataFrame, t: dict, timeout_ms: int | None = None) -> DataFrame:
    """(case_id, node, passing, n_events) of every case after each batch, in update mode.

    The stream has case_id, activity and us; events of a case in one batch are taken in order of us. The state of a
    case is its trie node and its number of events. With ``timeout_ms`` an idle case's state goes after that processing
    time and the case is reported with 'expired'.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"case_id": [key[0]], "node": [0], "passing": ["expired"], "n_events": [0]})
            return
        node, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        for a in rows["activity"]:
            node, n = advance(t, node, a), n + 1
        state.update((node, n))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"case_id": [key[0]], "node": [node], "passing": [",".join(t["passing"][node])], "n_events": [n]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("case_id").applyInPandasWithState(step, "case_id string, node int, passing string, n_events int", "node int, n int", "update", timeout)


def first_to_last_monitor(stream: DataFrame, a: str, b: str, limit_us: int, expiring: bool = False) -> DataFrame:
    """(case_id, status, elapsed_us, n_events) of the control that b follows the first a within a limit, in
    update mode; n_events says which of a case's rows is the newest.

    With ``expiring`` the stream needs a watermark: a case that stays silent is reported as violated when the watermark
    passes its limit, or as idle if it had no a, and its state goes. Events that come after that begin anew.
    """

    def say(key: tuple, status: str, elapsed: int | None, n: int) -> pd.DataFrame:
        return pd.DataFrame({"case_id": [key[0]], "status": [status], "elapsed_us": pd.array([elapsed], dtype="Int64"), "n_events": [n]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, seen, n = state.get if state.exists else (None, None, None, 0)
        if state.hasTimedOut:
            state.remove()
            done = last is not None and first is not None and last >= first
            yield say(key, "idle" if first is None else "satisfied" if done and last - first <= limit_us else "violated", None if first is None else (last - first if done else limit_us), n + 1)
            return
        for rows in batches:  # batch by batch: a case's events are never held together
            for kind in (a, b):
                at = rows.loc[rows["activity"] == kind, "us"]
                if len(at) and kind == a:
                    first = int(at.min()) if first is None else min(first, int(at.min()))
                elif len(at):
                    last = int(at.max()) if last is None else max(last, int(at.max()))
            seen, n = max(int(rows["us"].max()), seen or 0), n + len(rows)
        state.update((first, last, seen, n))
        if expiring:
            state.setTimeoutTimestamp(max(((first or seen) + limit_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elapsed = None if first is None else (last if last is not None and last >= first else seen) - first
        status = "idle" if first is None else "violated" if elapsed > limit_us else "satisfied" if last is not None and last >= first else "ticking"
        yield say(key, status, elapsed, n)

    timeout = GroupStateTimeout.EventTimeTimeout if expiring else GroupStateTimeout.NoTimeout
    return stream.groupBy("case_id").applyInPandasWithState(step, "case_id string, status string, elapsed_us bigint, n_events bigint", "first bigint, last bigint, seen bigint, n bigint", "update", timeout)


def committed_journeys(spark: SparkSession, folder: str) -> graph.Journeys:
    """The journeys up to the last committed batch of ``folder``; none before the first."""
    done = _parts(spark, f"{folder}/commits")
    empty = graph.no_journeys(spark)
    if not done:
        return empty
    read = lambda name, like, numbers: spark.read.schema(like.schema).parquet(*[f"{folder}/{name}/{n}" for n in numbers])
    return graph.Journeys(read("members", empty.members, done), read("keys", empty.keys, done), read("aliases", empty.aliases, done[-1:]))


def stitch_stream(stream: DataFrame, folder: str) -> DataFrame:
    """Journeys of a stream of (event_id, key), late bridges included: (event_id, journey_id).

    ``folder`` holds the stream's offsets, the members and keys that each batch added, each batch's alias table and one
    empty file for each committed batch, written last. A batch stitches itself and the journeys that it touches; a
    batch that is run again replaces its own uncommitted files, or is skipped if it was committed. A restart with the
    same folder goes on after the last commit and reads no earlier input again. Ids of one journey may change as late
    bridges arrive; the alias table says what each earlier id stands for now.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if number in _parts(own, f"{folder}/commits"):
            return
        added = graph.merge_batch(committed_journeys(own, folder), batch)
        for name, rows in (("members", added.members), ("keys", added.keys), ("aliases", added.aliases)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/{number}")
        fs, path = _path(own, f"{folder}/commits/{number}")
        fs.create(path, True).close()

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return committed_journeys(spark, folder).current()


def trie_rows(spark: SparkSession, t: dict) -> DataFrame:
    """The trie as a table (node, activity, next, passing)."""
    rows = [(n, a, m, json.dumps(t["passing"][m])) for n, f in t["next"].items() for a, m in f.items()]
    return spark.createDataFrame(rows, "node int, activity string, next int, passing string")
