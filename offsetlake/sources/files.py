"""Small files of a store through Hadoop's file systems: events, ledgers and manifests, a few bytes each."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _system(self, name: str):
        return self._path(name).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return self._system(name).exists(self._path(name))

    def names(self, name: str) -> list[str]:
        """Names in a folder, in order; none if it is not there. Hidden ones do not count."""
        if not self.exists(name):
            return []
        found = (s.getPath().getName() for s in self._system(name).listStatus(self._path(name)))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file that is not there yet; False if it is."""
        system, path = self._system(name), self._path(name)
        if system.exists(path):
            return False
        self.swap(name, data)
        return True

    def read(self, name: str) -> bytes:
        stream = self._system(name).open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def swap(self, name: str, data: bytes) -> None:
        """Puts a whole file in the place of another in one step: readers see the old one or the new one."""
        system, part, path = self._system(name), self._path(_hidden(name)), self._path(name)
        out = system.create(part, True)
        out.write(bytearray(data))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if "://" in self.root else self._jvm.java.net.URI.create("file:///"), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(system.makeQualified(part), system.makeQualified(path), options)

    def delete(self, name: str) -> None:
        self._system(name).delete(self._path(name), True)


def _hidden(name: str) -> str:
    folder, _, last = name.rpartition("/")
    return f"{folder}/.{last}.next" if folder else f".{last}.next"
