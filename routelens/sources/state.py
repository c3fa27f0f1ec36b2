"""State tables whose parts are replaced one by one.

A table is cut into parts by a partition column, a hash bucket or a day.  A version writes only the parts that it changes, into
a new folder ``data/<run>/<column>=<part>``, and becomes visible through its manifest, a small file that names the run which
wrote each part last, and what else is worth knowing of the part without opening it.  Readers open the parts they need.  So what
a version reads and writes follows the parts it touches and not the size of the table or the number of versions before it.
Manifests of more than ``keep`` versions ago, and data that no kept manifest names, are removed.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions that can be read and repeated.
KEEP = 20


def bucket_of(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Files:
    """The few things state needs of the store's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.system = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = spark._jvm.org.apache.commons.io.IOUtils

    def _path(self, path: str):
        return self.hadoop.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [x.getPath().getName() for x in self.system.listStatus(self._path(path))] if self.exists(path) else []

    def bytes(self, path: str) -> int:
        return self.system.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def delete(self, path: str) -> None:
        self.system.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self.system.open(self._path(path))
        try:
            return bytes(self.io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The file appears with all its content or not at all."""
        hidden = self._path(path.rpartition("/")[0] + "/." + path.rpartition("/")[2])
        stream = self.system.create(hidden, True)
        stream.write(text.encode())
        stream.close()
        self.system.delete(self._path(path), False)
        if not self.system.rename(hidden, self._path(path)):
            raise OSError(f"{path} could not be written")


@dataclass
class Manifest:
    """Parts by name with the ``run`` that wrote each and other facts, and facts of the whole table."""

    version: int = -1
    parts: dict[str, dict] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class PartedTable:
    def __init__(self, spark: SparkSession, root: str, column: str, schema: StructType):
        """``schema`` is that of the rows without ``column``."""
        self.spark, self.root, self.column, self.schema = spark, root.rstrip("/"), column, schema
        self.files = Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(x) for x in self.files.names(f"{self.root}/manifests") if x.isdigit())

    def manifest(self, before: int | None = None) -> Manifest:
        """The newest manifest, or the newest of a version below ``before``."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.manifest_of(found[-1]) if found else Manifest()

    def manifest_of(self, version: int) -> Manifest:
        return Manifest(**json.loads(self.files.read(f"{self.root}/manifests/{version}")))

    def read(self, manifest: Manifest, parts: list[str] | None = None) -> DataFrame:
        """The rows of some parts, or of all, without the partition column."""
        wanted = [p for p in (manifest.parts if parts is None else parts) if p in manifest.parts]
        paths = [f"{self.root}/data/{manifest.parts[p]['run']}/{self.column}={p}" for p in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, version: int) -> tuple[str, set[str]]:
        """Write rows, with the partition column, for a version; nothing shows before ``commit``.  Returns the run and its parts."""
        run = f"{version}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy(self.column).parquet(f"{self.root}/data/{run}")
        return run, parts_in(self.files, f"{self.root}/data/{run}", self.column)

    def commit(self, manifest: Manifest, keep: int = KEEP) -> None:
        self.files.write(f"{self.root}/manifests/{manifest.version}", json.dumps(manifest.__dict__))
        known = self.versions()
        if len(known) <= keep:
            return
        for v in known[:-keep]:
            self.files.delete(f"{self.root}/manifests/{v}")
        used: dict[str, set[str]] = {}
        for v in known[-keep:]:
            for part, facts in self.manifest_of(v).parts.items():
                used.setdefault(facts["run"], set()).add(part)
        for run in self.files.names(f"{self.root}/data"):
            folder = f"{self.root}/data/{run}"
            if run not in used:
                self.files.delete(folder)
            elif int(run.partition("-")[0]) < known[-keep]:  # parts that a later run replaced
                for part in parts_in(self.files, folder, self.column) - used[run]:
                    self.files.delete(f"{folder}/{self.column}={part}")


def parts_in(files: Files, folder: str, column: str) -> set[str]:
    return {x.partition("=")[2] for x in files.names(folder) if x.startswith(f"{column}=")}
