"""Restoring streamed fragments: tags that fragments cut are put together again before they are looked up.

The stateful part only re-cuts the fragments of a (session, stream, key): it holds back what may be the beginning of a
tag. Restoring is the batch operator over what comes out, inside foreachBatch. A `<` inside a held-back part starts
anew there; a part that grows over 50 characters, or can't become a tag, is let go; the end of a stream lets all go.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

from ..operators import codec, pseudonyms
from ..plans.pipeline import cache_restored
from ..sources import chat
from ..storage import written

#: Characters of an unfinished tag after which it is let go.
HELD = 50
_BEGINNING = re.compile(r"<(?:[A-Z_]*|[A-Z_]+_\d*)\Z")
FRAGMENT = "session string, stream string, key string, seq long, text string, last boolean"
OUT = "session string, stream string, key string, seq long, text string, last boolean"


def recut(held: str, fragment: str, last: bool) -> tuple[str, str]:
    """(what can go on, what is held back) of a held-back part and the fragment behind it."""
    text = held + (fragment or "")
    if last:
        return text, ""
    at = text.rfind("<")
    if at < 0 or len(text) - at > HELD or not _BEGINNING.match(text, at):
        return text, ""
    return text[:at], text[at:]


def recut_batch(fragments: DataFrame) -> DataFrame:
    """The same over a table of fragments: those of a (session, stream, key) in the order of seq."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, held, out = rows.sort_values("seq", kind="stable"), "", []
        for n, (text, last) in enumerate(zip(rows["text"], rows["last"], strict=True)):
            ready, held = recut(held, text, bool(last) or n == len(rows) - 1)
            out.append(ready)
        return rows.assign(text=out)

    return fragments.select("session", "stream", "key", "seq", "text", "last").groupBy("session", "stream", "key").applyInPandas(run, OUT)


class Recut(StatefulProcessor):
    """Keeps the held-back part of a (session, stream, key) to the stream's end, or for ttl_ms after it was last written."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = self.held.get()[0] if self.held.exists() else ""
        out = []
        for text, last in zip(batch["text"], batch["last"], strict=True):
            ready, held = recut(held, text, bool(last))
            out.append(ready)
        if bool(batch["last"].iloc[-1]):
            self.held.clear()
        else:
            self.held.update((held,))
        yield batch[["session", "stream", "key", "seq", "text", "last"]].assign(text=out)

    def close(self) -> None:
        pass


def recut_stream(fragments: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """fragments (FRAGMENT), streamed, re-cut so that no tag is cut. Needs the RocksDB state store; output mode update.

    A time to live needs the clock, and a query that needs it never runs out of batches: it must be stopped."""
    return fragments.groupBy("session", "stream", "key").transformWithStateInPandas(statefulProcessor=Recut(ttl_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def restore_stream(fragments: DataFrame, originals: DataFrame | Callable[[], DataFrame], sink, checkpoint: str, *, available_now: bool = True, ttl_ms: int = 300_000):
    """A started query: each micro-batch of re-cut fragments, restored (column restored), goes to sink(df, batch_id).

    available_now: it takes what is there and ends, without a time to live; else it runs on, abandoned parts expire.
    originals (session, tag, original): a function is called for each batch and so sees tags that are added while the
    query runs (lambda: state.read("originals")); a DataFrame keeps the files it was made of. Stop the query with
    query.stop(): state and offsets stay."""
    def one(batch: DataFrame, batch_id: int) -> None:
        # restoring reads the batch twice, and a store's version can be open only once: the stateful part runs first
        batch = batch.persist()
        try:
            batch.count()
            keyed = batch.withColumn("__row", F.concat_ws("\u0001", "session", "stream", "key", "seq"))
            now = originals() if callable(originals) else originals
            sink(pseudonyms.restore(keyed, now, id_col="__row", session="session", text="text").drop("__row"), batch_id)
        finally:
            batch.unpersist()

    writer = recut_stream(fragments, None if available_now else ttl_ms).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def full_texts(fragments: DataFrame, text: str = "text") -> DataFrame:
    """(session, stream, key, text): whole texts of finished streams, for the cache."""
    parts = fragments.groupBy("session", "stream", "key").agg(F.array_sort(F.collect_list(F.struct("seq", text))).alias("parts"), F.max(F.col("last").cast("int")).alias("done"))
    return parts.where("done = 1").select("session", "stream", "key", F.array_join(F.transform("parts", lambda p: F.coalesce(p.getField(text), F.lit(""))), "").alias("text"))


#: Fragments of one frame, at most: they are numbered inside it.
_IN_FRAME = 1 << 20


def _fragments(frames: DataFrame) -> DataFrame:
    """Fragments of the data frames, in the order of a chunk's fields; all details of a stream share one key."""
    data = frames.where("kind = 'data'").select("session", "stream", "seq", F.posexplode(codec.chunk_fields(chat.frame_chunk(F.col("frame")))).alias("n", "f"))
    return data.select("session", "stream", F.col("f.key").alias("key"), (F.col("seq") * _IN_FRAME + F.col("n")).alias("seq"), F.col("f.text").alias("text"), F.lit(False).alias("last"))


@F.pandas_udf(StringType())
def _with_texts(frames: pd.Series, texts: pd.Series) -> pd.Series:
    """Frames with the texts of their first choice's fields replaced; all else in their JSON stays."""

    def one(frame: str, own) -> str:
        body, left = json.loads(frame[6:]), iter(own)
        delta = body["choices"][0]["delta"]
        for key in ("content", "reasoning"):
            if delta.get(key) is not None:
                delta[key] = next(left)
        for detail in delta.get("reasoning_details") or []:
            if detail.get("text") is not None:
                detail["text"] = next(left)
        return "data: " + json.dumps(body, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([frame if own is None else one(frame, own) for frame, own in zip(frames, texts, strict=True)], dtype=object)


def restore_frames(frames: DataFrame, originals: DataFrame, state: pseudonyms.Store | None = None) -> DataFrame:
    """(session, stream, seq, kind, frame): event-stream frames (session, stream, seq, frame) with their tags restored.

    Tags that frames cut come out whole in the frame where they end; what is held back at a stream's end goes out with its
    key's last fragment. [DONE], comments and frames that can't be read pass as they are. state: the whole texts of the
    streams that have ended with [DONE] are written back to its cache."""
    marked = frames.select("session", "stream", F.col("seq").cast("long").alias("seq"), "frame").withColumn("kind", chat.frame_kind(F.col("frame")))
    pieces = _fragments(marked)
    ready = recut_batch(pieces).withColumn("__row", F.concat_ws("\u0001", "session", "stream", "key", "seq"))
    back = pseudonyms.restore(ready, originals, id_col="__row", session="session", text="text").drop("__row")
    if state is not None:
        back = written(back, "fragments")
        done = marked.where("kind = 'done'").select("session", "stream").distinct()
        ended = back.withColumn("last", F.lit(True)).join(done, ["session", "stream"], "left_semi")
        texts = full_texts(ended.drop("restored"), "text").join(full_texts(ended.drop("text"), "restored").withColumnRenamed("text", "restored"), ["session", "stream", "key"])
        cache_restored(texts, state, session="session", restored="restored", anonymized="text")
    whole = back.groupBy("session", "stream", F.floor(F.col("seq") / _IN_FRAME).alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.pmod("seq", F.lit(_IN_FRAME)).alias("n"), "restored"))).alias("t"))
    joined = marked.join(whole, ["session", "stream", "seq"], "left")
    return joined.select("session", "stream", "seq", "kind", F.when(F.col("t").isNull(), F.col("frame")).otherwise(_with_texts("frame", F.transform("t", lambda x: x.restored))).alias("frame"))


def frames_text(frames: DataFrame, key: str = "content") -> DataFrame:
    """(session, stream, text): what the data frames of a stream say under a key, put together."""
    own = _fragments(frames).where(F.col("key") == key)
    return own.groupBy("session", "stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"))
