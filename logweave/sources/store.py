"""A log and its tables in a folder: segments of Parquet, published by manifests.

A commit writes its segments and tables first and then one manifest, the next in number, that names all of them. A manifest
is created where none may be yet, so of two rivals one fails and has published nothing; readers see the last whole one.
(On stores where a file can't be created only if it's absent, keep to one writer.)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import log as L

LOG = "global_seq long, id string, stream_id string, seq long, type string, created_at timestamp_ntz, causation_id string, correlation_id string, metadata map<string,string>, payload string"
#: The tables beside the log and what they hold when they are new.
TABLES = {
    "heads": "stream_id string, seq long, updated_at timestamp_ntz",
    "groups": "group_id string, status string, retry_at timestamp_ntz, retries long, error_context string, updated_at timestamp_ntz",
    "offsets": "group_id string, stream_id string, global_seq long, high_water long, claimed boolean, claimed_at timestamp_ntz, claimed_by string",
    "scheduled": "schedule_id long, id string, stream_id string, type string, available_at timestamp_ntz, created_at timestamp_ntz, causation_id string, correlation_id string, metadata map<string,string>, payload string",
    "workers": "id string, last_seen timestamp_ntz",
}


class Store:
    """A log in a folder that the whole cluster shares. Tables are DataFrames; each commit replaces those it names, or adds to the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _file(self, name: str = ""):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self._conf)

    def _versions(self) -> list[int]:
        p, fs = self._file("manifests")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, version: int) -> dict:
        p, fs = self._file(f"manifests/v{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def installed(self) -> bool:
        return bool(self._versions())

    def install(self) -> Store:
        """An empty log, unless there is one."""
        if not self.installed():
            self._publish(0, {"log": [], "top": 0, "tables": {}})
        return self

    def uninstall(self) -> None:
        p, fs = self._file()
        fs.delete(p, True)

    def clear(self) -> Store:
        """Empties the log and its tables, for tests."""
        self.uninstall()
        return self.install()

    def _publish(self, version: int, manifest: dict) -> None:
        p, fs = self._file(f"manifests/v{version:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise L.ConcurrentAppendError(f"version {version} is taken") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _now(self) -> tuple[int, dict]:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no log in {self.path}")
        return versions[-1], self._manifest(versions[-1])

    def _write(self, df: DataFrame, name: str) -> str:
        place = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{place}")
        return place

    def log(self) -> DataFrame:
        _, m = self._now()
        reader = self.spark.read.schema(LOG)
        return reader.parquet(*[f"{self.path}/{s}" for s in m["log"]]) if m["log"] else self.spark.createDataFrame([], LOG)

    def table(self, name: str) -> DataFrame:
        _, m = self._now()
        schema = TABLES[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{m['tables'][name]}") if name in m["tables"] else self.spark.createDataFrame([], schema)

    def commit(self, appended: DataFrame | None = None, base: int | None = None, **tables: DataFrame) -> int:
        """All or nothing: numbered messages are added to the log, tables replaced. ``base``: the version the work began from,
        the last if not given; if another has been published since, ConcurrentAppendError, and nothing is."""
        version, m = self._now()
        version = version if base is None else base
        if unknown := tables.keys() - TABLES.keys():
            raise KeyError(unknown)
        if appended is not None:
            segment = self._write(_as(appended, LOG), "log")
            new = self.spark.read.schema(LOG).parquet(f"{self.path}/{segment}")
            m = {**m, "log": [*m["log"], segment], "top": new.agg(F.coalesce(F.max("global_seq"), F.lit(m["top"]))).first()[0]}
            tables["heads"] = L.advanced(self.table("heads"), new)
        written = {name: self._write(_as(df, TABLES[name]), name) for name, df in tables.items()}
        self._publish(version + 1, {**m, "tables": {**m["tables"], **written}})
        return version + 1

    def append_next(self, messages: DataFrame, order: str = "arrival", **tables: DataFrame) -> DataFrame:
        """Messages as appended; only the streams' heads are read."""
        version, m = self._now()
        rows = L.append_next(self.log(), messages, order, self.table("heads"), m["top"])
        self.commit(rows, version, **tables)
        return rows

    def append_after(self, messages: DataFrame, order: str = "seq") -> None:
        """Messages of one stream whose callers chose seq; a taken one is a ConcurrentAppendError, and nothing is appended."""
        version, m = self._now()
        L.append_after(self.log(), messages)
        self.commit(L.with_global_seq(messages, order, m["top"]), version)

    def promote(self, now, limit: int | None = 100) -> int:
        """Due messages go from the schedule to the log in one commit; their number."""
        version, m = self._now()
        scheduled = self.table("scheduled")
        taken = L.due(scheduled, now, limit)
        n = taken.count()
        if n:
            rest = scheduled.join(taken.select("schedule_id"), "schedule_id", "left_anti")
            rows = L.append_next(self.log(), taken.withColumn("created_at", F.lit(now)), "schedule_id", self.table("heads"), m["top"])
            self.commit(rows, version, scheduled=rest)
        return n


def _as(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns: those it lacks are null, others go."""
    fields = [f.strip().split(" ") for f in schema.replace("map<string,string>", "map<string;string>").split(",")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t.replace(";", ",")).alias(c) for c, t in fields])


def encoded(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with ``payload``, JSON of the named columns, in their place."""
    return df.withColumn("payload", F.to_json(F.struct(*fields))).drop(*fields)


def decoded(log: DataFrame, types: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """By type, the log's messages with their payload's fields as columns, read by the schema that the registry has for the type.
    A missing payload counts as ``{}``; what isn't of the schema is null."""
    rows = {t: log.where(F.col("type") == t) for t in types}
    return {t: df.withColumn("_p", F.from_json(F.coalesce("payload", F.lit("{}")), types[t])).select(*[c for c in log.columns if c != "payload"], "_p.*") for t, df in rows.items()}


def fetch(schema: StructType, name: str) -> Column:
    """A payload's field; KeyError if its schema has none of that name."""
    if name not in schema.fieldNames():
        raise KeyError(name)
    return F.col("payload").getField(name)


def invalid(log: DataFrame, required: dict[str, dict[str, str]]) -> DataFrame:
    """Messages that no registry would take, with ``error``: types it doesn't know, streams without a name, and required
    payload fields (name to SQL type) that are missing or can't be read as such."""
    known = F.col("type").isin(list(required)) if required else F.lit(False)
    found = [F.when(~known | F.col("type").isNull(), "unknown type"), F.when(F.coalesce(F.length("stream_id"), F.lit(0)) == 0, "no stream")]
    for t, fields in required.items():
        for name, kind in fields.items():
            value = F.get_json_object(F.coalesce("payload", F.lit("{}")), f"$.{name}")
            found.append(F.when((F.col("type") == t) & value.try_cast(kind).isNull(), f"{name} is no {kind}"))
    return log.withColumn("error", F.array_join(F.array_compact(F.array(*found)), "; ")).where("error <> ''")


def open_log(where, spark: SparkSession | None = None):
    """The log for what a configuration names: ``memory:``, a folder, or any object that itself appends and reads."""
    from ..reactors import Memory

    if where == "memory:":
        return Memory()
    if isinstance(where, str):
        return Store(spark or SparkSession.active(), where).install()
    needed = ("append_next", "append_after", "promote")
    if missing := [n for n in needed if not callable(getattr(where, n, None))]:
        raise TypeError(f"no log: it lacks {missing}")
    return where
