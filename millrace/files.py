"""Small files on the cluster's own file systems, through Hadoop's client on the driver.

Data files are written and read by Spark or by tasks; this is for the few markers and pointers beside them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from millrace.session import local_path


def _of(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; a plain one is on the cluster's default file system, the same on every machine."""
    if path.startswith("file:/") and "//" not in path and not path.endswith("/"):
        return path  # as it is already; asking Hadoop takes milliseconds
    place, store = _of(spark, path)
    return store.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _of(spark, path)
    return store.exists(place)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all; FileExistsError where there is one already."""
    if path.startswith("file:") and _linked(local_path(path), text):
        return
    place, store = _of(spark, path)
    store.mkdirs(place.getParent())
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(temporary, False)
    out.write(text.encode())
    out.close()
    # A rename without the option to overwrite fails where the name is taken.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), store.getConf())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(store.makeQualified(temporary), store.makeQualified(place), options)
    except Exception as error:
        store.delete(temporary, False)
        if "FileAlreadyExists" in str(error):
            raise FileExistsError(path) from None
        raise


def _linked(path: str, text: str) -> bool:
    """``publish_text`` on this machine, without the programs that Hadoop's client starts there for each file; whether its disk knows links."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "w") as out:
        out.write(text)
    try:
        # A link is never made over a name that is taken.
        os.link(temporary, path)
    except FileExistsError:
        raise FileExistsError(path) from None
    except OSError:
        return False
    finally:
        os.unlink(temporary)
    return True


def delete(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    """Whether there was something to delete."""
    place, store = _of(spark, path)
    return store.delete(place, recursive)
