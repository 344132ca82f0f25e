"""Incremental ingest: new image files become vectors as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenaudit.operators.raster import Embedder, embed_images
from lumenaudit.sources.images import has_ending, origin_path


def stream_embeddings(spark: SparkSession, folder: str, out: str, checkpoint: str, decode: Callable[[DataFrame], DataFrame] | None = None, embedder: str | Callable[[], Embedder] = "histogram", files_per_batch: int = 1000, once: bool = True, progress: Callable[[int], None] | None = None) -> StreamingQuery:
    """Embeds the images that are new in ``folder`` and adds them to ``out``.

    The stream's checkpoint remembers which files are done, so a restarted job continues;
    each micro-batch writes its own folder, and a repeated one replaces it. ``once``: stop
    when all present files are done. ``decode`` turns rows ``path`` into ``path, image``;
    by default Spark's image source reads them. ``progress`` is called after every batch
    with the number of files done since the start.
    """
    done = [0]
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    paths = files.select("path").where(has_ending(F.col("path")))

    def images(batch: DataFrame) -> DataFrame:
        names = [r["path"] for r in batch.collect()]  # at most files_per_batch
        if not names:
            return spark.createDataFrame([], "path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
        return spark.read.format("image").option("dropInvalid", False).load(names).select(origin_path(F.col("image.origin")).alias("path"), "image")

    def write(batch: DataFrame, number: int) -> None:
        embed_images((decode or images)(batch), embedder).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        if progress:
            done[0] += batch.count()
            progress(done[0])

    writer = paths.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status(query: StreamingQuery) -> str:
    """``running``, ``done`` or ``failed: ...`` of a started ingest."""
    if query.isActive:
        return "running"
    error = query.exception()
    return f"failed: {error}" if error else "done"


def wait(query: StreamingQuery, seconds: float) -> str:
    """Waits until the ingest has ended, at most ``seconds``; then stops it. What was written stays, and a restart goes on from there."""
    try:
        if not query.awaitTermination(seconds):
            query.stop()
            return "stopped"
    except Exception as e:  # noqa: BLE001  the stream's own error
        return f"failed: {e}"
    return status(query)
