"""Opening files by path or URI."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return uri if "://" not in uri else None


def open_input(uri: str):
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def open_output(uri: str):
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(name)


def exists(uri: str) -> bool:
    path = local_path(uri)
    if path is not None:
        return os.path.exists(path)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    return system.get_file_info(name).type != fs.FileType.NotFound


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where that is unset, a temporary folder is chosen once, but on one machine
    alone: on a cluster others wouldn't see it, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cloudgrid.shared.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cloudgrid-")
        spark.conf.set("cloudgrid.shared.dir", root)
    return root.rstrip("/")
