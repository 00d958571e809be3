"""Picture files: written from rows by tasks, read by Spark's file sources."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bitmap(height: int, pixels: bytes) -> bytes:
    """A bitmap file of gray pixels, row by row from the top."""
    width = len(pixels) // height
    pad = b"\0" * (-width % 4)
    rows = b"".join(pixels[k * width : (k + 1) * width] + pad for k in reversed(range(height)))
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    head = 14 + 40 + len(palette)
    return struct.pack("<2sIHHI", b"BM", head + len(rows), 0, 0, head) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(rows), 2835, 2835, 256, 0) + palette + rows


def write_pictures(pictures: DataFrame, folder: str) -> None:
    """A file for each row (file_id, height, pixels in hexadecimal digits); one that has no pixels becomes a file that is no picture.

    Tasks write through the file system of the folder's address; a task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        system.create_dir(path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                good = row["height"] and row["pixels"]
                data = bitmap(row["height"], bytes.fromhex(row["pixels"])) if good else b"not a picture"
                with system.open_output_stream(f"{path}/{row['file_id']:020d}.bmp") as out:
                    out.write(data)
            yield batch.select(["file_id"])

    pictures.select("file_id", "height", "pixels").mapInArrow(write, "file_id bigint").write.format("noop").mode("overwrite").save()


def _with_id(rows: DataFrame, path: str) -> DataFrame:
    return rows.withColumn("file_id", F.regexp_extract(path, r"(\d+)\.bmp$", 1).cast("bigint"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, path, length, modificationTime, content) of the files; content is read only where it is used."""
    return _with_id(spark.read.format("binaryFile").load(folder), "path")


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, image) of the files that decode as pictures; the others are left out."""
    return _with_id(spark.read.format("image").option("dropInvalid", True).load(folder), "image.origin")
