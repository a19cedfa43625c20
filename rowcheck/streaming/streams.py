"""The gate on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from rowcheck.operators.gate import gate
from rowcheck.operators.intake import Extractor, take_in
from rowcheck.plans.spec import Rule, TableSpec
from rowcheck.sources import files, sinks
from rowcheck.sources.shared import scratch  # noqa: F401


def stream_gate(
    staged: DataFrame, spec: TableSpec, rules: Sequence[Rule], out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """M1: each micro-batch of a landing stream is gated whole and appended under `out`.

    A file is complete when it arrives, so a document's number convention is taken inside its batch. A batch is a commit of write_gated
    under its own number, so one that is repeated after a failure replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        sinks.write_gated(gate(df, spec, rules), out, f"b{number}", replace=False)

    return _started(staged, batch, checkpoint, once)


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def landing_files(spark: SparkSession, path: str, most: int = 1000, most_bytes: int | None = None) -> DataFrame:
    """A stream of the files that arrive under `path`: path, length, begin, seq, content. most: files of a micro-batch; most_bytes: their bytes
    instead, so that the number of micro-batches follows the bytes that land and not the number of small files.

    Files of up to files.LARGE bytes come whole, with a null begin; larger ones in pieces (files.in_pieces), so that no task holds one, unless
    their name says that they are packed: those Spark's text reader would unpack. Each way lists the folder and keeps its own record of what it took.
    """
    bound = ("maxFilesPerTrigger", most) if most_bytes is None else ("maxBytesPerTrigger", most_bytes)
    # by what Spark knows of a file before it is opened: what the other way takes is not read
    name, length = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    large = length > files.LARGE
    for ending in _packed(spark):
        large = large & ~name.endswith(ending)
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.option("recursiveFileLookup", "true").option(*bound)
    none = F.lit(None).cast("long")
    whole = source.format("binaryFile").schema(schema).load(path).where(~large).select(
        "path", "length", none.alias("begin"), none.alias("seq"), "content"
    )
    lines = source.format("text").schema("value string").option("lineSep", "\n").load(path).where(large).select(
        # the path as binaryFile writes it
        F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("path"),
        length.alias("length"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.col("value").cast("binary").alias("content"),
    )
    return whole.unionByName(files.in_pieces(lines))


def _packed(spark: SparkSession) -> list[str]:
    """Endings of the names that Spark's text reader takes for packed files."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted(hadoop.util.ReflectionUtils.newInstance(codec, conf).getDefaultExtension() for codec in codecs)


def stream_intake(
    landed: DataFrame,
    spec: TableSpec,
    rules: Sequence[Rule],
    out: str,
    checkpoint: str,
    aliases: DataFrame | None = None,
    extractor: Extractor | None = None,
    once: bool = True,
) -> StreamingQuery:
    """M1: each micro-batch of landed files goes through all of take_in; rows, findings and run log are one commit.

    A document is one file, so nothing that it settles (headings, number convention, key, completeness) reaches beyond its batch, and the
    tables are those of take_in over all files at once. Each table holds a batch under its number and readers (sinks.committed) see it
    once all three are written: a run that is killed and started again gives the tables of one that was not.
    """

    def batch(df: DataFrame, number: int) -> None:
        key = f"b{number}"
        place = f"{out}/parsed/batch={key}"

        def parsed(records: DataFrame) -> DataFrame:
            # a reader holds a column of a row group, and most of a record is in one column
            records.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(place)
            return records.sparkSession.read.schema(records.schema).parquet(place)

        taken = take_in(df, spec, rules, aliases, extractor, lambda rows: sinks.put_rows(rows, out, key), parsed)
        sinks.put(taken.found, out, "findings", key)
        sinks.put(taken.log, out, "log", key)
        sinks.commit(df.sparkSession, out, key)
        sinks.remove(df.sparkSession, place)

    return _started(landed, batch, checkpoint, once)


def stream_checks(stream: DataFrame, spec: TableSpec, rules: Sequence[Rule]) -> DataFrame:
    """M2: rows of a stream with their findings; only what one row settles (declared scales, no document convention)."""
    return gate(stream, spec, rules, infer=False)


def stream_rate_limit(stream: DataFrame, per_minute: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """M3: allowed and refused requests per caller and window; late events count in their own window until the watermark.

    In append mode a window is given once, when the watermark has passed it, and its state goes; what comes later is dropped.
    """
    counts = stream.withWatermark("ts", late).groupBy(
        F.window("ts", f"{seconds} seconds"), "who"
    ).agg(F.count("*").alias("n"))
    allowed = F.col("n") if per_minute == 0 else F.least(F.col("n"), F.lit(per_minute))
    return counts.select(
        "who",
        F.col("window.start").alias("start"),
        "n",
        allowed.alias("allowed"),
        (F.col("n") - allowed).alias("refused"),
    )


class _Limiter(StatefulProcessor):
    """Requests of a caller as they come: a count a window, which goes when the watermark passes the window's end."""

    def __init__(self, limit: int, seconds: int, nearest: bool):
        self.limit, self.seconds, self.nearest = limit, seconds, nearest

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window long", "n long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        came = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"], kind="stable")
        micros = came["ts"].astype("datetime64[us]").astype("int64")
        second = (micros / 1_000_000).round().astype("int64") if self.nearest else micros // 1_000_000
        window = second // self.seconds
        open_ = (window + 1) * self.seconds * 1000 > timerValues.getCurrentWatermarkInMs()
        came, window = came[open_], window[open_]
        refused = pd.Series(False, index=came.index)
        for number, own in came.groupby(window):
            before = self.counts.getValue((int(number),))[0] if self.counts.containsKey((int(number),)) else 0
            if not before:
                self.handle.registerTimer((int(number) + 1) * self.seconds * 1000)
            self.counts.updateValue((int(number),), (before + len(own),))
            refused[own.index] = before + 1 + pd.RangeIndex(len(own)).to_numpy() > self.limit
        if len(came):
            yield came.assign(window_no=window, refused=refused)[["id", "who", "ts", "window_no", "refused"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ended = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.seconds - 1
        if self.counts.containsKey((ended,)):
            self.counts.removeKey((ended,))
        return iter(())

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_refusals(
    stream: DataFrame, per_minute: int, seconds: int = 60, late: str = "10 minutes", nearest: bool = False
) -> DataFrame:
    """M3: requests (id, who, ts) of a stream as they come, with window_no and `refused`: request n of its caller's window is refused if n is
    over the limit, in the order of micro-batches and of (ts, id) inside one. nearest: windows by the nearest whole second, else by the one begun.

    What is late counts in its own window until the watermark has passed that; then it is dropped and the window's state is gone, as is
    that of callers who do not come again. (Spark itself drops requests that are older than the watermark before last.) A caller's requests of a micro-batch are one group: maxFilesPerTrigger bounds it. The state
    lies in RocksDB (the session's spark.sql.streaming.stateStore.providerClass must name it).
    """
    asked = stream.select(F.col("id").cast("long").alias("id"), F.col("who").cast("string").alias("who"), F.col("ts").cast("timestamp").alias("ts"))
    return asked.withWatermark("ts", late).groupBy("who").transformWithStateInPandas(
        statefulProcessor=_Limiter(per_minute, seconds, nearest),
        outputStructType="id long, who string, ts timestamp, window_no long, refused boolean",
        outputMode="append",
        timeMode="eventTime",
    )


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a finished run of `stream` appends, read back from `path`."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def landing(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A stream of staged rows that arrive as parquet files in the folder `path`."""
    return spark.readStream.schema(schema).parquet(path)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream, be it one file or a folder of part files: a file is found in its folder by its name."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    parts = spark.read.parquet(path).select("_metadata.file_name").limit(1).collect()
    if not parts or parts[0][0] != name:
        return landing(spark, path, schema)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def totals(stream: DataFrame, folder: str) -> DataFrame:
    """The complete result of an aggregating stream once all input is read; each micro-batch replaces the table before it."""
    writer = stream.writeStream.outputMode("complete").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
