"""Event streams of audit agents (T1-T5): typed NDJSON, progress state, last result, retained logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import byte_size, preview

EVENT = "session_id string, seq bigint, type string, task_id string, agent string, description string, status string, summary string, text string, result string, total_cost_usd double, message string"
TYPES = ["started", "completed", "text", "result", "error"]


def read_events(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """One JSON object a line; unknown types are ignored."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).json(folder).where(F.col("type").isin(TYPES))


def log_level(text: Column | str) -> Column:
    """T5: ERROR for lines with [FATAL] or [ERROR] or that begin with ERROR, WARN for [WARN] or a beginning WARN, else INFO. Upper case only; NULL is INFO."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.contains("[FATAL]") | t.contains("[ERROR]") | F.startswith(t, F.lit("ERROR")), "ERROR").when(t.contains("[WARN]") | F.startswith(t, F.lit("WARN")), "WARN").otherwise("INFO")


def log_line(text: Column | str) -> Column:
    """T5: a line as it is logged: without carriage returns, line breaks as ` | `."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" | "))


def last_results(events: DataFrame) -> DataFrame:
    """(session_id, state, result): the last result of each session; an error or a blank last result makes the session ERROR."""
    e = events.groupBy("session_id").agg(F.max(F.when(F.col("type") == "result", F.struct("seq", "result"))).alias("r"), F.bool_or(F.col("type") == "error").alias("failed"))
    ok = ~F.col("failed") & (F.trim(F.coalesce("r.result", F.lit(""))) != "")
    return e.select("session_id", F.when(ok, "OK").otherwise("ERROR").alias("state"), F.col("r.result").alias("result"))


class Progress(StatefulProcessor):
    """Running tasks of a session and the number completed; a completion names the agent that its start gave."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "task_id string", "agent string")
        self.done = handle.getValueState("done", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        n = self.done.get()[0] if self.done.exists() else 0
        out = []
        for e in events.itertuples():
            if e.type == "started":
                agent = e.agent or e.task_id
                self.active.updateValue((e.task_id,), (agent,))
                out.append((key[0], e.seq, "started", agent, None, n, None, None))
            elif e.type == "completed":
                n += 1
                agent = e.task_id
                if self.active.containsKey((e.task_id,)):
                    agent = self.active.getValue((e.task_id,))[0]
                    self.active.removeKey((e.task_id,))
                left = sum(1 for _ in self.active.keys())
                status = {"completed": "done", "stopped": "stopped"}.get(e.status, "failed")
                out.append((key[0], e.seq, "completed", agent, status, n, n + left, e.summary))
        self.done.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "type", "agent", "status", "completed", "total", "summary"])

    def close(self) -> None:
        pass


PROGRESS = "session_id string, seq bigint, type string, agent string, status string, completed int, total int, summary string"


def progress(events: DataFrame) -> DataFrame:
    """T2 as a streaming query: one row for each start and completion, with counters, size and preview of the summary."""
    p = events.where(F.col("type").isin("started", "completed")).groupBy("session_id").transformWithStateInPandas(Progress(), PROGRESS, "Append", "None")
    return p.withColumns({"result_size": byte_size(F.octet_length("summary")), "preview": preview("summary", 200)}).drop("summary")


def progress_batch(events: DataFrame) -> DataFrame:
    """T2 over a finished log: completed = completions up to here, total = completed + tasks still running; window over a session's start and end marks."""
    from pyspark.sql import Window

    e = events.where(F.col("type").isin("started", "completed"))
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    task = Window.partitionBy("session_id", "task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # a start opens a task unless it is open already; a completion closes one only if it is open
    e = e.withColumn("_before", F.lag("type").over(Window.partitionBy("session_id", "task_id").orderBy("seq")))
    opened = F.when((F.col("type") == "started") & (F.coalesce("_before", F.lit("")) != "started"), 1).when((F.col("type") == "completed") & (F.col("_before") == "started"), -1).otherwise(0)
    e = e.withColumn("_open", opened)
    agent = F.coalesce(F.when(F.col("_before") == "started", F.last(F.when(F.col("type") == "started", F.coalesce("agent", "task_id")), ignorenulls=True).over(task)), F.when(F.col("type") == "started", F.col("agent")), F.col("task_id"))
    done = F.count(F.when(F.col("type") == "completed", 1)).over(w).cast("int")
    status = F.when(F.col("type") == "completed", F.when(F.col("status") == "completed", "done").when(F.col("status") == "stopped", "stopped").otherwise("failed"))
    total = F.when(F.col("type") == "completed", (done + F.sum("_open").over(w)).cast("int"))
    return e.select("session_id", "seq", "type", agent.alias("agent"), status.alias("status"), done.alias("completed"), total.alias("total"), byte_size(F.octet_length("summary")).alias("result_size"), preview("summary", 200).alias("preview"))


LOG = "job_id string, seq bigint, line string, level string, batch bigint"
#: Fixed value: the line that ends a job's log.
DONE = "[DONE]"


def broadcast_logs(lines: DataFrame, folder: str, checkpoint: str, follow: bool = False):
    """Appends (job_id, seq, line) micro-batches with their level to the table in `folder`, from which any number of readers replay and follow. Returns the running
    query; it ends with what is available unless `follow`."""

    def write(batch: DataFrame, number: int) -> None:
        level = log_level(log_line("line"))
        batch.select("job_id", "seq", F.replace("line", F.lit("\n"), F.lit("\\n")).alias("line"), level.alias("level"), F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(folder)

    out = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out if follow else out.trigger(availableNow=True)).start()


def tail_logs(spark: SparkSession, folder: str, most: int = 2000, finished: DataFrame | None = None) -> DataFrame:
    """The last `most` lines of each job, in order, without rows that a restarted batch wrote twice; the jobs of finished(job_id) end with [DONE], also those without a line."""
    from ..operators.report import retained

    rows = retained(spark.read.schema(LOG).parquet(folder).dropDuplicates(["job_id", "seq"]), "job_id", "seq", most).select("job_id", "seq", "line", "level")
    if finished is not None:
        last = rows.groupBy("job_id").agg(F.max("seq").alias("last"))
        ends = finished.select("job_id").distinct().join(last, "job_id", "left")
        rows = rows.unionByName(ends.select("job_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("seq"), F.lit(DONE).alias("line"), F.lit("INFO").alias("level")))
    return rows.orderBy("job_id", "seq")


def follow_logs(spark: SparkSession, folder: str, history: DataFrame) -> DataFrame:
    """The live part of a subscription: a stream of the lines that come after those of `history` (from tail_logs())."""
    last = history.where(F.col("line") != DONE).groupBy("job_id").agg(F.max("seq").alias("last"))
    live = spark.readStream.schema(LOG).parquet(folder)
    return live.join(last, "job_id", "left").where("last is null or seq > last").select("job_id", "seq", "line", "level")
