"""Landing folders by arrival: what is read is known from the newest folders alone.

Files land in folders whose names ascend with the time of arrival, such as
``arrived=2024-01-10``. Bronze keeps the folder of each row as a partition. So the newest
folder in bronze is the offset, and only folders after it, and the last few before it, which
may still receive files, are listed. Files in those are compared with bronze's own rows of
the same folders. Nothing grows with the number of files, neither on the driver nor in a
checkpoint, and modification times play no part.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_FOLDERS = 2


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``, ascending; none if it does not exist."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(folder):
        return []
    found = (s for s in system.listStatus(folder) if s.isDirectory())
    names = (s.getPath().getName() for s in found)
    return sorted(n for n in names if not n.startswith(("_", ".")))


def folders_to_read(landed: list[str], ingested: list[str], open_folders: int = OPEN_FOLDERS) -> list[str]:
    """Landing folders that can hold files not ingested yet."""
    if not ingested:
        return landed
    offset = max(ingested)
    known = [name for name in landed if name <= offset]
    still_open = known[-open_folders:] if open_folders else []
    return [*still_open, *(name for name in landed if name > offset)]


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the partition column right below ``path``, from the names of its folders."""
    prefix = f"{column}="
    names = (n for n in folder_names(spark, path) if n.startswith(prefix))
    return sorted(unquote(n.removeprefix(prefix)) for n in names)


def folder_of(source: str = "source_file") -> Column:
    """The name of the folder that holds a file, of its URI."""
    return F.try_url_decode(F.replace(F.element_at(F.split(source, "/"), -2), F.lit("+"), F.lit("%2B")))


def unread_files(files: DataFrame, ingested: DataFrame | None, source: str = "source_file") -> DataFrame:
    """Files that no row of ``ingested`` came from."""
    if ingested is None:
        return files
    return files.join(ingested.select(source).distinct(), source, "left_anti")
