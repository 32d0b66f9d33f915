"""Sources and sinks of chat traffic: JSON bodies, event-stream frames, conversations, pools, state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.codec import CHUNK, REQUEST
from ..operators.pseudonyms import clear_session

DONE = "[DONE]"


def parsed_requests(bodies: DataFrame, body: str = "body", schema: str = REQUEST) -> tuple[DataFrame, DataFrame]:
    """(requests with `request` beside the raw body, dead letters with status 400): bodies that are no JSON objects."""
    valid = F.expr(f"try_parse_json(`{body}`)").isNotNull() & F.startswith(F.ltrim(F.col(body)), F.lit("{"))
    marked = bodies.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    good = marked.where("__ok").withColumn("request", F.from_json(body, schema, {"mode": "PERMISSIVE"})).drop("__ok")
    bad = marked.where(~F.col("__ok")).drop("__ok").withColumns({"status": F.lit(400), "error": F.lit("invalid JSON")})
    return good, bad


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Bodies (body), one a line."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def stream_requests(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Bodies as they arrive; max_files bounds what one trigger takes on."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "body")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Event-stream frames (frame): what stands between blank lines."""
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "frame").where(F.col("frame") != "")


def split_frames(df: DataFrame, body: str, id_col: str) -> DataFrame:
    """(id_col, seq, frame) of event-stream bodies."""
    return df.select(id_col, F.posexplode(F.split(body, "\n\n")).alias("seq", "frame")).where(F.col("frame") != "")


def frame_kind(frame: Column) -> Column:
    """done, data (JSON that parses) or other: to be passed on as it is."""
    payload = F.substring(frame, 7, 1 << 28)
    is_data = F.startswith(frame, F.lit("data: "))
    parses = F.call_function("try_parse_json", payload).isNotNull() & F.startswith(F.ltrim(payload), F.lit("{"))
    return F.when(is_data & (F.trim(payload) == DONE), "done").when(is_data & parses, "data").otherwise("other")


def frame_chunk(frame: Column) -> Column:
    """A data frame's body as CHUNK; null for others."""
    return F.when(F.startswith(frame, F.lit("data: ")), F.from_json(F.substring(frame, 7, 1 << 28), CHUNK))


def write_responses(df: DataFrame, path: str, response: str = "response") -> None:
    """JSON lines (response, status, error): 502 where the upstream gave none, or what can't be read."""
    ok = F.call_function("try_parse_json", F.col(response)).isNotNull()
    df.select(response, F.when(ok, 200).otherwise(502).alias("status"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("no readable upstream response")).alias("error")).write.json(path)


def responded(df: DataFrame, respond, schema: str) -> DataFrame:
    """df through an upstream: a function of an iterator of pandas frames, called on the executors."""
    return df.mapInPandas(respond, schema)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Generated conversations: one JSON array of (id, entities, turns)."""
    return spark.read.json(path, multiLine=True, schema="id string, entities map<string,string>, turns array<struct<role:string,content:string>>")


def write_conversations(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(type, values) of a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("type", "values"))


def read_templates(spark: SparkSession, path: str, role: str = "user") -> DataFrame:
    """(kind, text) of a JSON object: role, then kind, then a list of texts."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    return whole.select(F.explode(F.element_at("m", role)).alias("kind", "texts")).select("kind", F.explode("texts").alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of a proxy or garbage-collector log."""
    return spark.read.text(path)


class StateTables:
    """The state of sessions as Parquet tables in one folder, partitioned by a hash of the session, so that clearing or
    reading a session touches one part."""

    SCHEMAS = {
        "tags": "session string, type string, value string, tag string, pos struct<order:long,field:int,start:int>",
        "originals": "session string, tag string, original string",
        "cache": "session string, text_hash string, anonymized string",
    }
    NAMES = tuple(SCHEMAS)

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("session"), F.lit(self.parts)).cast("int")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], self.SCHEMAS[name]).columns).withColumn("part", self._part()).write.mode("append").partitionBy("part").parquet(f"{self.folder}/{name}")

    def clear(self, sessions: DataFrame) -> None:
        """Deletes the sessions (session) from all tables: the parts that hold them are written anew, no others."""
        parts = [r.part for r in sessions.select(self._part().alias("part")).distinct().collect()]  # at most `parts`
        for name in self.NAMES:
            if not parts or not storage.exists(self.spark, f"{self.folder}/{name}"):
                continue
            rows = self._whole(name).where(F.col("part").isin(*parts))
            kept = storage.written(clear_session(rows, sessions), f"kept-{name}")
            left = {r.part for r in kept.select("part").distinct().collect()}
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")
            for part in set(parts) - left:
                storage.remove(self.spark, f"{self.folder}/{name}/part={part}")
            storage.removed(kept)

    def _whole(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMAS[name]}, part int").parquet(f"{self.folder}/{name}")

    def read(self, name: str, session: str | None = None) -> DataFrame:
        """A table as it is now; empty where nothing was written yet."""
        if not storage.exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        df = self._whole(name)
        if session is not None:
            own = self.spark.range(1).select(F.lit(session).alias("session")).select(self._part().alias("p")).first().p
            df = df.where((F.col("part") == own) & (F.col("session") == session))
        return df.drop("part")
