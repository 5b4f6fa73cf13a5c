"""Files under chosen names, made visible all at once.

Spark names its part files itself and commits them one folder at a time. Here they are written to a
hidden folder (its name begins with ``_``, so Spark's readers pass over it), get their names there,
and the folder is renamed into place last: a run that dies leaves nothing visible, and a goal that
exists is left alone. Only names go through the driver, never rows. On stores whose rename copies
(object stores), the last step isn't atomic.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hidden_beside(goal: str) -> str:
    """A new hidden folder's path in the folder that ``goal`` is to be in."""
    parent, _, name = goal.rstrip("/").rpartition("/")
    return f"{parent}/_{name}-{uuid4().hex}"


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as the tasks' own ``open`` takes it, if it is in a file system of the machines; None in any other store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below ``folder``, relative to it, in order. A listed file is itself and a listed folder
    what is in it, so all folders of a level are opened by one call, until nothing changes. Files' rights
    aren't read: a local store starts a process for each."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = files.getFileStatus(at).getPath().toString()
    level, found = None, hadoop.FileUtil.stat2Paths(files.listStatus(at))
    while level is None or not spark._jvm.java.util.Objects.deepEquals(level, found):
        level, found = found, hadoop.FileUtil.stat2Paths(files.listStatus(found))
    return sorted(f.toString()[len(top) + 1 :] for f in found)


def publish(spark: SparkSession, hidden: str, goal: str, name: Callable[[str], str | None], threads: int = 16, staged: str | None = None) -> list[str]:
    """Gives each file below ``hidden`` the path that ``name`` makes of its own (None: it goes) in ``staged``, a
    hidden folder where other files may have their names already, then renames that folder to ``goal``.
    Returns the names that it gave. Two files of one name are an error, and a goal that exists raises
    ``FileExistsError``; both leave the goal as it was."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = hadoop.Path(hidden).getFileSystem(conf)
    old = files_below(spark, hidden)
    new = {f: n for f in old if (n := name(f)) is not None}
    if len(set(new.values())) < len(new):
        raise ValueError("two files would share a name")
    staged = staged or f"{hidden}/_named"
    for folder in {f"{staged}/{n}".rpartition("/")[0] for n in new.values()} | {staged}:
        files.mkdirs(hadoop.Path(folder))

    def moved(pair: tuple[str, str]) -> bool:
        return files.rename(hadoop.Path(f"{hidden}/{pair[0]}"), hadoop.Path(f"{staged}/{pair[1]}"))

    with ThreadPoolExecutor(threads) as pool:
        if not all(pool.map(moved, new.items())):
            raise OSError(f"a file of {hidden} could not be renamed")
    context = hadoop.FileContext.getFileContext(hadoop.Path(goal).toUri(), conf)
    try:
        context.rename(hadoop.Path(staged), hadoop.Path(goal), spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as failed:
        if context.util().exists(hadoop.Path(goal)):
            raise FileExistsError(goal) from failed
        raise
    files.delete(hadoop.Path(hidden), True)
    return sorted(new.values())
