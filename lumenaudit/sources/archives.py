"""Archives of images, as they are uploaded."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import SparkSession


def put(spark: SparkSession, path: str, content: bytes, modified: int | None = None) -> None:
    """Writes a small file wherever Spark can write; ``modified``: its time, in milliseconds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    try:
        out.write(content)
    finally:
        out.close()
    if modified is not None:
        fs.setTimes(at, modified, -1)


def unpack(spark: SparkSession, archive: str, folder: str, most_bytes: int = 2 << 30) -> int:
    """Unpacks a ZIP file into ``folder`` and gives the number of files.

    The archive (one upload, below 2 GB) is read and unpacked on the driver, member by
    member. Members whose name leads out of the folder are an error, as are archives that
    unpack to more than ``most_bytes``; folders and hidden or junk members are left to the
    readers. An empty archive gives 0.
    """
    raw = spark.read.format("binaryFile").load(archive).select("content").first()[0]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        if sum(m.file_size for m in members) > most_bytes:
            raise ValueError(f"{archive}: unpacks to more than {most_bytes} bytes")
        for m in members:
            parts = m.filename.replace("\\", "/").split("/")
            if m.filename.startswith("/") or ".." in parts or ":" in parts[0]:
                raise ValueError(f"{archive}: member {m.filename!r} leads out of the folder")
        for m in members:
            put(spark, f"{folder.rstrip('/')}/{m.filename}", z.read(m))
    return len(members)
