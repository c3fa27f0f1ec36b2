"""The layout of stored traffic: batches as they arrive, merged by day from time to time.

Every batch writes its own folder, a file per day and task.  ``compact_traffic`` merges finished batches into a table with one part
per day, see ``sources.state``: only the days that the batches touch are read and written, in files of a target size, sorted by
time, so that scans skip row groups by their least and greatest times.  ``read_traffic`` joins both, opening only the wanted days.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.schemas import TRAFFIC
from routelens.sources.state import Files, Manifest, PartedTable, parts_in

TARGET_BYTES = 256 << 20
#: What a task of a compaction sorts, in memory; stored rows are often a tenth or less of that.
SORT_BYTES = 256 << 20
#: Compacted states that can still be read.
KEEP = 2
_ROW = T.StructType([*TRAFFIC.fields, T.StructField("path_pattern", T.StringType())])


def _days(spark: SparkSession, store: str) -> PartedTable:
    return PartedTable(spark, f"{store}/traffic-days", "dt", _ROW)


def _batches(files: Files, store: str) -> list[int]:
    return sorted(int(b) for b in parts_in(files, f"{store}/traffic", "batch_id"))


def _folders(files: Files, store: str, batches: list[int], wanted=lambda day: True) -> dict[str, str]:
    """Day by folder of the batches' wanted days."""
    found = {}
    for b in batches:
        root = f"{store}/traffic/batch_id={b}"
        found |= {f"{root}/dt={day}": day for day in parts_in(files, root, "dt") if wanted(day)}
    return found


def _sort_bytes(rows: DataFrame) -> int:
    """Bytes that a sort holds for the rows: eight for each value, texts beside them, and what points at a row."""
    texts = [f.name for f in _ROW.fields if isinstance(f.dataType, T.StringType)]
    size = F.lit(8 * (len(_ROW.fields) + len(texts)) + 32).cast("bigint")
    for c in texts:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return rows.agg(F.sum(size)).first()[0] or 0


def compact_traffic(spark: SparkSession, store: str, upto: int, target_bytes: int = TARGET_BYTES, keep: int = KEEP) -> None:
    """Merge all batches up to ``upto``, which are finished, into days.  They must not run again.

    Folders of batches that an earlier compaction merged, and states of days beyond the last ``keep``, are removed.
    """
    table = _days(spark, store)
    before = table.manifest()
    merged = before.facts.get("upto", -1)
    fresh = _folders(table.files, store, [b for b in _batches(table.files, store) if merged < b <= upto])
    if not fresh:
        return
    days = sorted(set(fresh.values()))
    old = [f"{table.root}/data/{before.parts[d]['run']}/dt={d}" for d in days if d in before.parts]
    size = sum(table.files.bytes(x) for x in [*fresh, *old])
    rows = spark.read.schema(_ROW).parquet(*fresh, *old).withColumn("dt", F.col("timestamp").cast("date"))
    tasks = max(1, -(-size // target_bytes), -(-_sort_bytes(rows) // SORT_BYTES))
    # rows of one time, or without any, may be many: their ids deal them to several tasks
    placed = rows.repartitionByRange(tasks, "dt", "timestamp", "record_id").sortWithinPartitions("dt", "timestamp")
    run, made = table.write(placed, upto)
    parts = {d: x for d, x in before.parts.items() if d not in days}
    table.commit(Manifest(upto, parts | {d: {"run": run} for d in made}, {"upto": upto}), keep)
    for b in _batches(table.files, store):
        if b <= merged:  # readers that began before this compaction still find the batches it merged
            table.files.delete(f"{store}/traffic/batch_id={b}")


def read_traffic(spark: SparkSession, store: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Stored traffic, of the days from ``first_day`` to ``last_day`` (``yyyy-mm-dd``) if given; rows without time have no day."""
    table = _days(spark, store)
    manifest = table.manifest()

    def wanted(day: str) -> bool:
        dated = day[:1].isdigit() or not (first_day or last_day)
        return dated and (first_day is None or day >= first_day) and (last_day is None or day <= last_day)

    merged = manifest.facts.get("upto", -1)
    fresh = _folders(table.files, store, [b for b in _batches(table.files, store) if b > merged], wanted)
    out = table.read(manifest, [d for d in manifest.parts if wanted(d)])
    return out.unionByName(spark.read.schema(_ROW).parquet(*fresh)) if fresh else out
