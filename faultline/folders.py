"""Files and folders of any store that Spark writes to, through Hadoop's file system classes.

Only names are handled here, by the driver; what files hold is read and written by Spark.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import SparkSession

_RENAMES_AT_A_TIME = 16


class Folder:
    """A folder of the session's store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._system = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def exists(self, name: str) -> bool:
        return self._system.exists(self._at(f"{self.path}/{name}"))

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, or in a folder in it; markers and hidden files left out."""
        found = self._system.listStatus(self._at(f"{self.path}/{name}" if name else self.path))
        names = (status.getPath().getName() for status in found)
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def make(self) -> None:
        self._system.mkdirs(self._at(self.path))

    def move(self, old: str, new: str) -> None:
        """Rename within the folder; an error if ``new`` is there."""
        if not self._system.rename(self._at(f"{self.path}/{old}"), self._at(f"{self.path}/{new}")):
            raise OSError(f"cannot rename {self.path}/{old} to {new}")

    def move_all(self, pairs: list[tuple[str, str]]) -> None:
        with ThreadPool(_RENAMES_AT_A_TIME) as pool:
            pool.starmap(self.move, pairs)

    def remove(self, name: str) -> None:
        self._system.delete(self._at(f"{self.path}/{name}"), True)

    def read(self, name: str) -> str | None:
        """A short text file; None if there is none."""
        if not self.exists(name):
            return None
        stream = self._system.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str, scratch: str) -> None:
        """Put a short text file in the place of an older one, in one step.

        Readers see the old text or the new one, never a part, where the store renames in one step.
        """
        stream = self._system.create(self._at(f"{self.path}/{scratch}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = getattr(self._hadoop, "Options$Rename")
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(
            self._system.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        context.rename(
            self._at(f"{self.path}/{scratch}"), self._at(f"{self.path}/{name}"), overwrite
        )
