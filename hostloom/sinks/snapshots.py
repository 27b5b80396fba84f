"""The table of latest snapshots, as files and over JDBC."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.functions.payload import json_value
from hostloom.operators.ingest import as_snapshots, newest, reduce_to_latest
from hostloom.session import file_system, remove_folder, scratch, settle
from hostloom.sinks.base import Sink

# Fixed value: name of the table.
TABLE = "t_host_snapshots"

REDUCED = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def accepted_rows() -> Column:
    """The judged rows that belong in the table."""
    return F.col("reason").isNull()


@dataclass(frozen=True)
class Version:
    """One state of the table: the folder that holds each bucket."""

    number: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "buckets": self.buckets, "folders": self.folders}, sort_keys=True)

    @classmethod
    def parse(cls, text: str) -> Version:
        raw = json.loads(text)
        return cls(raw["number"], raw["buckets"], {int(k): v for k, v in raw["folders"].items()})


class SnapshotTable:
    """Latest snapshot per machine in a versioned table of hash buckets.

    A machine lives in one bucket. An upsert reduces its batch to one row per machine,
    merges it with the buckets these machines live in, writes these buckets to a new
    folder and commits a manifest that names the folder of each bucket. Readers take
    the newest manifest and open one folder per bucket; there is nothing to fold, and a
    version that is being read stays as it is until ``vacuum`` removes it.

    The commit is optimistic: a manifest's name is its number and is taken by one writer
    only. The other one starts over from the newer version, rewriting buckets only if
    they were changed there. Merging takes a minimum and the greatest (``updated_at``,
    ``seq``), so replayed, late and twice-stored batches change nothing.

    ``buckets`` counts for a new table; bucket files should have some 100 MB. The file
    system must not let a rename replace a file: local ones and HDFS do.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets

    # --- versions ---

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version:
        """A version by its number, the newest one by default; without any, the empty table."""
        if number is None:
            known = self.versions()
            if not known:
                return Version(0, self.buckets)
            number = known[-1]
        fs, at = file_system(self.spark, self._manifest(number))
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version.parse(text)

    def _commit(self, version: Version) -> bool:
        """Publish a version; false when its number is taken."""
        fs, draft = file_system(self.spark, f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(version.text().encode()))
        stream.close()
        _, final = file_system(self.spark, self._manifest(version.number))
        try:
            return self._take(fs, draft, final)
        finally:
            fs.delete(draft, False)

    def _take(self, fs, draft, final) -> bool:
        if fs.getScheme() != "file":
            return not fs.exists(final) and fs.rename(draft, final)
        # a local rename replaces the target, a link does not
        jvm = self.spark.sparkContext._jvm
        source, target = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (draft, final))
        try:
            jvm.java.nio.file.Files.createLink(target, source)
        except Py4JJavaError as exc:
            if "FileAlreadyExists" in str(exc.java_exception):
                return False
            raise
        return True

    # --- writing ---

    def upsert(self, rows: DataFrame, batch: str) -> None:
        """Apply accepted envelope rows."""
        with scratch(self.spark):
            self.upsert_reduced(reduce_to_latest(rows), batch)

    def upsert_reduced(self, reduced: DataFrame, batch: str) -> None:
        """Apply rows with one state per machine and batch."""
        with scratch(self.spark):
            base = self.version()
            bucket = F.pmod(F.xxhash64("machine_id"), F.lit(base.buckets)).cast("int")
            incoming = settle(reduced.select(*REDUCED.names).withColumn("bucket", bucket), "incoming")
            # at most as many numbers as the table has buckets
            touched = {r.bucket for r in incoming.select("bucket").distinct().collect()}
            folder, seen = None, {}
            while touched:
                now = {b: base.folders.get(b) for b in touched}
                if folder is None or now != seen:
                    if folder:
                        remove_folder(self.spark, f"{self.path}/data/{folder}")
                    folder, seen = self._merged(incoming, base, touched), now
                if self._commit(Version(base.number + 1, base.buckets, base.folders | dict.fromkeys(touched, folder))):
                    return
                base = self.version()

    def _merged(self, incoming: DataFrame, base: Version, touched: set[int]) -> str:
        folder = uuid.uuid4().hex
        stored = self._read(base, touched)
        rows = incoming if stored is None else incoming.unionByName(stored)
        newest(rows.repartition("bucket"), ["bucket"]).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the ``keep`` newest versions; returns the number of folders removed.

        Run it when no reader uses older ones any more. Folders that no manifest has
        ever named belong to writers at work and stay.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        used = {f for n in kept for f in self._paths(self.version(n))}
        unused = {f for n in old for f in self._paths(self.version(n))} - used
        for path in unused:
            remove_folder(self.spark, path)
        for n in old:
            remove_folder(self.spark, self._manifest(n))
        return len(unused)

    # --- reading ---

    def _paths(self, version: Version, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(version.folders.items())
                if buckets is None or b in buckets]

    def _read(self, version: Version, buckets: set[int] | None = None) -> DataFrame | None:
        paths = self._paths(version, buckets)
        if not paths:
            return None
        rows = self.spark.read.schema(REDUCED).parquet(*paths)
        return rows.withColumn("bucket", F.pmod(F.xxhash64("machine_id"), F.lit(version.buckets)).cast("int"))

    def reduced(self, number: int | None = None) -> DataFrame:
        """The stored rows of a version, the newest one by default."""
        rows = self._read(self.version(number))
        return self.spark.createDataFrame([], REDUCED) if rows is None else rows.drop("bucket")

    def read(self, number: int | None = None) -> DataFrame:
        return as_snapshots(self.reduced(number))

    def sink(self) -> Sink:
        return Sink("mysql", accepted_rows(), self.upsert)


def snapshot_columns(snapshots: DataFrame) -> DataFrame:
    """Snapshots as the stored columns: arrays and structs as JSON text."""
    return snapshots.select(
        "machine_id", "host_name",
        json_value(F.col("ips")).alias("ips"), json_value(F.col("stats")).alias("stats"),
        "created_at", "updated_at", "seq")


def table_statements(table: str) -> list[str]:
    """SQL that makes the table, one row per machine by a unique key."""
    return [
        f"CREATE TABLE IF NOT EXISTS {table} (id BIGINT UNSIGNED AUTO_INCREMENT PRIMARY KEY, "
        "machine_id VARCHAR(64) NOT NULL, host_name VARCHAR(255), ips JSON, stats JSON, created_at DATETIME(6), "
        "updated_at DATETIME(6), deleted_at DATETIME(6), seq BIGINT NOT NULL DEFAULT 0, "
        "UNIQUE KEY uk_machine_id (machine_id))",
    ]


def merge_statements(table: str, stage: str) -> list[str]:
    """SQL that applies a staging table: update machines to newer samples, insert new ones.

    Newer is the greater (``updated_at``, ``seq``), as in the file table. Late and replayed
    batches change nothing, and the first one dates a machine. Of two writers that insert
    one machine at once the unique key lets the second one update instead.
    """
    columns = "machine_id, host_name, ips, stats, created_at, updated_at, seq"
    later = "(s.updated_at, s.seq) > (t.updated_at, t.seq)"
    return [
        f"INSERT INTO {table} ({columns}) SELECT s.machine_id, s.host_name, s.ips, s.stats, s.created_at, s.updated_at, s.seq "
        f"FROM {stage} s LEFT JOIN {table} t ON t.machine_id = s.machine_id WHERE t.machine_id IS NULL "
        "ON DUPLICATE KEY UPDATE machine_id = VALUES(machine_id)",
        f"UPDATE {table} t JOIN {stage} s ON t.machine_id = s.machine_id "
        "SET t.created_at = LEAST(t.created_at, s.created_at)",
        f"UPDATE {table} t JOIN {stage} s ON t.machine_id = s.machine_id "
        "SET t.host_name = s.host_name, t.ips = s.ips, t.stats = s.stats, t.updated_at = s.updated_at, t.seq = s.seq "
        f"WHERE {later}",
    ]


def jdbc_sink(url: str, user: str, password: str, table: str = TABLE, writers: int = 16) -> Sink:
    """Snapshots into a MySQL table; needs the database's JDBC driver on the class path.

    Executors write the reduced batch to a staging table; the database merges it.
    """
    def put(rows: DataFrame, batch: str) -> None:
        stage = f"{table}_stage_{batch.replace('-', '_')}"
        staged = snapshot_columns(as_snapshots(reduce_to_latest(rows)))
        (staged.repartition(writers).write.format("jdbc").mode("overwrite")
         .option("url", url).option("dbtable", stage)
         .option("user", user).option("password", password).save())
        jvm = rows.sparkSession.sparkContext._jvm
        connection = jvm.java.sql.DriverManager.getConnection(url, user, password)
        try:
            connection.setAutoCommit(False)
            for sql in (*table_statements(table), *merge_statements(table, stage)):
                connection.createStatement().executeUpdate(sql)
            connection.commit()
            connection.createStatement().executeUpdate(f"DROP TABLE {stage}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return Sink("mysql", accepted_rows(), put)


def quarantine_sink(path: str) -> Sink:
    """Rows that are not written to the snapshot table, with their reason."""
    def put(rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return Sink("quarantine", F.col("reason").isNotNull(), put)
