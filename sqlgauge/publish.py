"""Pointer files: what a folder's readers see is switched in one step.

Data is written under names of its own and published by a small JSON file that names
it. Replacing that file is a rename over the old one where the store can do that
(HDFS, local disks) and a whole-file write elsewhere (object stores, where a file
appears when it is complete), so a reader sees the old text or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from sqlgauge.session import _hadoop, delete_path


def write_pointer(spark: SparkSession, path: str, content: dict) -> None:
    """Make ``content`` what readers of ``path`` see."""
    jvm = spark._jvm
    text = bytearray(json.dumps(content, sort_keys=True).encode())
    fs, target = _hadoop(spark, path)
    folder, name = path.rsplit("/", 1)
    _, draft = _hadoop(spark, f"{folder}/.{name}-{uuid.uuid4().hex[:12]}")
    out = fs.create(draft, True)
    try:
        out.write(text)
    finally:
        out.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), spark._jsc.hadoopConfiguration())
    except Exception:  # noqa: BLE001 - a store without renames over files
        context = None
    if context is None:
        out = fs.create(target, True)
        out.write(text)
        out.close()
        delete_path(spark, draft.toString())
        return
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What ``path`` says, or None if it was never written."""
    fs, target = _hadoop(spark, path)
    if not fs.exists(target):
        return None
    handle = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(handle, "UTF-8")
    finally:
        handle.close()
    return json.loads(text)
