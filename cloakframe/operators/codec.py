"""Chat messages: fields out of requests and responses as rows, and back; prompts; the mock responder."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import is_blank
from ..functions.registry import load
from .detect import tags

FIELDS = ("content", "reasoning", "thought")
MESSAGE = "struct<role:string,content:string,reasoning:string,thought:string>"
REQUEST = f"struct<model:string,user:string,stream:boolean,messages:array<{MESSAGE}>>"
RESPONSE = "struct<choices:array<struct<message:struct<role:string,content:string,reasoning:string,reasoning_details:array<struct<text:string>>>>>>"
CHUNK = "struct<choices:array<struct<delta:struct<content:string,reasoning:string,reasoning_details:array<struct<text:string>>>>>>"
NOTE = "\n\n[Gateway Note]: "


class Codec(Protocol):
    """How a provider's bodies become rows of text and back."""

    def request_fields(self, df: DataFrame, id_col: str, messages: str) -> DataFrame: ...

    def response_fields(self, response: Column, all_choices: bool = False) -> Column: ...

    def chunk_fields(self, chunk: Column) -> Column: ...


def request_fields(df: DataFrame, id_col: str, messages: str = "messages") -> DataFrame:
    """(id_col, msg, field, text) of every field of every message, whatever its role, that has text."""
    at = df.select(id_col, F.posexplode(messages).alias("msg", "m"))
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(name).alias("name"), F.col(f"m.{name}").alias("text")) for n, name in enumerate(FIELDS)))
    return at.select(id_col, "msg", F.inline(pairs)).where(~is_blank(F.col("text")))


def with_fields(df: DataFrame, fields: DataFrame, id_col: str, messages: str = "messages", text: str = "anonymized") -> DataFrame:
    """df with the fields' texts (id_col, msg, field, text) put back into its messages."""
    packed = fields.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "msg", "field"), F.col(text)))).alias("__new"))
    new = lambda i, n, old: F.coalesce(F.try_element_at(F.col("__new"), F.concat_ws(":", i.cast("string"), F.lit(str(n)))), old)
    rebuilt = F.transform(F.col(messages), lambda m, i: F.struct(m.role.alias("role"), *(new(i, n, m.getField(name)).alias(name) for n, name in enumerate(FIELDS))))
    return df.join(packed, id_col, "left").withColumn(messages, F.when(F.col("__new").isNotNull(), rebuilt).otherwise(F.col(messages))).drop("__new")


def response_fields(response: Column, all_choices: bool = False) -> Column:
    """array<struct<key, text>>: content, reasoning and the first reasoning detail of the first choice, or of all."""
    one = lambda c: F.array(*(F.struct(F.lit(k).alias("key"), v.alias("text")) for k, v in (("content", c.message.content), ("reasoning", c.message.reasoning), ("reasoning_details", F.try_element_at(c.message.reasoning_details, F.lit(1)).text))))
    chosen = response.choices if all_choices else F.slice(response.choices, 1, 1)
    return F.filter(F.flatten(F.transform(chosen, one)), lambda x: x.text.isNotNull())


def chunk_fields(chunk: Column) -> Column:
    """array<struct<key, text>> of a streamed chunk: the first choice's content, reasoning and all of its details."""
    delta = F.try_element_at(chunk.choices, F.lit(1)).delta
    plain = F.array(*(F.struct(F.lit(k).alias("key"), delta.getField(k).alias("text")) for k in ("content", "reasoning")))
    details = F.transform(F.coalesce(delta.reasoning_details, F.array().cast("array<struct<text:string>>")), lambda d: F.struct(F.lit("reasoning_details").alias("key"), d.text.alias("text")))
    return F.filter(F.concat(plain, details), lambda x: x.text.isNotNull())


def with_response_fields(response: Column, change, all_choices: bool = False) -> Column:
    """The response with change(text) in place of the fields that response_fields gives; null texts stay null."""
    detail = lambda ds: F.transform(ds, lambda d, n: F.when((n == 0) & d.text.isNotNull(), d.withField("text", change(d.text))).otherwise(d))
    one = lambda m: m.withField("content", change(m.content)).withField("reasoning", change(m.reasoning)).withField("reasoning_details", detail(m.reasoning_details))
    return response.withField("choices", F.transform(response.choices, lambda c, n: F.when(F.lit(all_choices) | (n == 0), c.withField("message", one(c.message))).otherwise(c)))


def data_frame(content: Column | None = None, reasoning: Column | None = None, details: Column | None = None) -> Column:
    """An event-stream frame of one chunk; parts that are null are left out."""
    none, no_details = F.lit(None).cast("string"), F.lit(None).cast("array<struct<text:string>>")
    delta = F.struct((none if content is None else content).alias("content"), (none if reasoning is None else reasoning).alias("reasoning"), (no_details if details is None else details).alias("reasoning_details"))
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"))))


def with_prompt(messages: Column, prompt: str) -> Column:
    """The gateway's note: behind the text of a leading system or developer message, else as a system message before all.

    A blank prompt, or no messages, changes nothing."""
    if not (prompt or "").strip():
        return messages
    first = F.try_element_at(messages, F.lit(1))
    noted = F.transform(messages, lambda m, i: F.when(i == 0, m.withField("content", F.concat(F.coalesce(m.content, F.lit("")), F.lit(NOTE + prompt)))).otherwise(m))
    added = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("thought"))), messages)
    return F.when(messages.isNull() | (F.size(messages) == 0), messages).when(first.role.isin("system", "developer"), noted).otherwise(added)


class OpenAi:
    """The default codec."""

    request_fields, with_fields, response_fields, with_response_fields, chunk_fields = map(staticmethod, (request_fields, with_fields, response_fields, with_response_fields, chunk_fields))


CODECS: dict[str, type] = {"openai": OpenAi}


def codec(name: str | None) -> type:
    """By short name, in any case (none: the default), or module.Class of one's own."""
    key = (name or "openai").strip().lower()
    return CODECS[key] if key in CODECS else load(name)


def user_tags(messages: Column) -> Column:
    """Distinct tags of the users' messages, in order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(messages, lambda m: m.role == "user"), lambda m: tags(m.content))))


def token_count(text: Column) -> Column:
    """Runs of anything but white space."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, r"\s+")))


#: Texts that the responder fills in; %s stands for a tag.
REPLIES = ("Noted, %s. Anything else?", "I have updated %s and will contact %s.", "Thanks, %s is confirmed for %s at %s.")
NO_TAGS = "I understand. How can I help you?"


def mock_reply(known: Column, seed: Column) -> Column:
    """A reply that names the tags: chosen by a hash of the seed, filled in order, the last tag repeated where too few."""
    n = F.size(known)
    own = [F.concat(*(x for k, part in enumerate(reply.split("%s")) for x in ([F.lit(part)] if k == 0 else [F.get(known, F.least(F.lit(k - 1), n - 1)), F.lit(part)]))) for reply in REPLIES]
    pick = F.pmod(F.xxhash64(seed), F.lit(len(REPLIES)))
    chosen = own[-1]
    for k in reversed(range(len(REPLIES) - 1)):
        chosen = F.when(pick == k, own[k]).otherwise(chosen)
    return F.when(n > 0, chosen).otherwise(F.lit(NO_TAGS))


def session_tags(df: DataFrame, session: str, order: str, found: str) -> DataFrame:
    """(session, tags): the tags of a session's requests, each once, as first seen."""
    each = df.select(session, order, F.posexplode(found).alias("n", "tag")).groupBy(session, "tag").agg(F.min(F.struct(order, "n")).alias("first"))
    return each.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x.tag).alias("tags"))
