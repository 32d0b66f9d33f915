"""Token classification: decoders of labelled tokens into spans, and models as batch functions.

A decoder takes an array<struct<token, start, end, label>> column and the text; tokens of a null start are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import NO_SPANS
from ..functions.registry import load

TOKENS = "array<struct<token:string,start:int,end:int,label:string>>"


def argmax(scores: Column) -> Column:
    """Position, from 0, of the largest score; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def labels_of(logits: Column, id2label: dict[int, str]) -> Column:
    """A label for each token's scores; classes that have no name are O."""
    names = F.create_map(*(F.lit(x) for k, v in id2label.items() for x in (int(k), v)))
    return F.transform(logits, lambda scores: F.coalesce(F.try_element_at(names, argmax(scores)), F.lit("O")))


def _spans(found: Column, text: Column, ignored: tuple[str, ...], mapping: dict[str, str]) -> Column:
    """Found entities (start, end, label) as spans: labels in `ignored` go, then labels are mapped."""
    kept = F.filter(found, lambda e: ~e.label.isin(*ignored)) if ignored else found
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)) if mapping else None
    named = lambda label: label if names is None else F.coalesce(F.try_element_at(names, label), label)
    return F.transform(kept, lambda e: F.struct(e.start.alias("start"), e.end.alias("end"), F.lit("MODEL").alias("type"), named(e.label).alias("raw_type"), F.substring(text, e.start + 1, e.end - e.start).alias("value")))


def decode_bio(tokens: Column, text: Column, ignored: tuple[str, ...] = (), mapping: dict[str, str] | None = None, *, suffix_match: bool = False, bioes: bool = False) -> Column:
    """B- opens an entity; I- of its label extends it, and so does a ## token of any label but B-; all else ends it.

    suffix_match: I- extends wherever its label ends in the entity's. bioes: S- is an entity, E- extends and ends one."""
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    entity = lambda s, e, label: F.struct(s.alias("start"), e.alias("end"), label.alias("label"))
    state = lambda out, now: F.struct(out.alias("out"), now.alias("now"))
    nothing = F.lit(None).cast("struct<start:int,end:int,label:string>")

    def step(a: Column, t: Column) -> Column:
        flushed = F.when(a.now.isNotNull(), F.array_append(a.out, a.now)).otherwise(a.out)
        name = F.substring(t.label, 3, 1 << 20)
        same = F.endswith(t.label, a.now.label) if suffix_match else name == a.now.label
        longer = state(a.out, entity(a.now.start, t.end, a.now.label))
        out = F.when(t.start.isNull(), a).when(F.startswith(t.label, F.lit("B-")), state(flushed, entity(t.start, t.end, name)))
        if bioes:
            out = out.when(F.startswith(t.label, F.lit("S-")), state(F.array_append(flushed, entity(t.start, t.end, name)), nothing))
            out = out.when(F.startswith(t.label, F.lit("E-")) & a.now.isNotNull() & same, state(F.array_append(a.out, entity(a.now.start, t.end, a.now.label)), nothing))
        out = out.when(F.startswith(t.label, F.lit("I-")) & a.now.isNotNull() & same, longer)
        return out.when(a.now.isNotNull() & F.startswith(t.token, F.lit("##")), longer).otherwise(state(flushed, nothing))

    typed = F.transform(F.coalesce(tokens, F.array().cast(TOKENS)), lambda t: F.struct(t.token.alias("token"), t.start.cast("int").alias("start"), t.end.cast("int").alias("end"), F.coalesce(t.label, F.lit("O")).alias("label")))
    found = F.aggregate(typed, state(none, nothing), step, lambda a: F.when(a.now.isNotNull(), F.array_append(a.out, a.now)).otherwise(a.out))
    return F.coalesce(_spans(found, text, ignored, mapping or {}), F.array().cast(NO_SPANS))


def decode_simple(tokens: Column, text: Column, ignored: tuple[str, ...] = (), mapping: dict[str, str] | None = None) -> Column:
    """A span for each token whose label is not O; neighbours are never merged."""
    labelled = F.filter(F.coalesce(tokens, F.array().cast(TOKENS)), lambda t: t.start.isNotNull() & (F.coalesce(t.label, F.lit("O")) != "O"))
    found = F.transform(labelled, lambda t: F.struct(t.start.cast("int").alias("start"), t.end.cast("int").alias("end"), t.label.alias("label")))
    return _spans(found, text, ignored, mapping or {})


DECODERS: dict[str, Callable[..., Column]] = {"BIO": decode_bio, "SIMPLE": decode_simple}


def decoder(name: str) -> Callable[..., Column]:
    """By short name, or module.function of one's own."""
    return DECODERS[name.upper()] if name.upper() in DECODERS else load(name)


def active_labels(labels: Column, ignored: Column) -> Column:
    """Distinct labels, without O and without B-, I- and E- before them, that are not ignored, sorted."""
    bare = F.transform(F.filter(labels, lambda x: x != "O"), lambda x: F.regexp_replace(x, "^[BIE]-", ""))
    return F.array_sort(F.array_except(F.array_distinct(bare), ignored))


Model = Callable[[list[str]], list[list[tuple[str, int, int, str]]]]


def tokens_udf(load: Callable[[], Model], batch_size: int = 16, on_error: str = "skip"):
    """A pandas UDF from texts to TOKENS; the model is loaded once a task and fed batches of batch_size texts.

    on_error skip: a failed batch has no tokens and null stands for them, so that callers can tell it from "none found"
    and keep it out of the cache; fail: the task fails."""

    @F.pandas_udf(TOKENS)
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list = [[] for _ in range(len(texts))]
            live = [n for n, text in enumerate(texts) if isinstance(text, str) and text.strip()]
            for at in range(0, len(live), batch_size):
                part = live[at : at + batch_size]
                try:
                    found = model([texts.iloc[n] for n in part])
                    if len(found) != len(part):
                        raise ValueError("a model gives one list of tokens for each text")
                except Exception:
                    if on_error == "fail":
                        raise
                    found = [None] * len(part)
                for n, row in zip(part, found, strict=True):
                    out[n] = None if row is None else [{"token": t, "start": s, "end": e, "label": label} for t, s, e, label in row]
            yield pd.Series(out)

    return tokens


def onnx_model(directory: str, threads: int = 1) -> Callable[[], Model]:
    """Loader of an ONNX token classifier: the folder's *.onnx, config.json (id2label) and tokenizer.json.

    Only the inputs that the model declares are fed; a batch is padded to its longest text."""

    def load() -> Model:
        import json

        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        folder = Path(directory)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        session = onnxruntime.InferenceSession(str(sorted(folder.glob("*.onnx"))[0]), options)
        names = {int(k): v for k, v in json.loads((folder / "config.json").read_text())["id2label"].items()}
        tokenizer = Tokenizer.from_file(str(folder / "tokenizer.json"))
        tokenizer.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
            made = tokenizer.encode_batch(texts)
            feeds = {"input_ids": [e.ids for e in made], "attention_mask": [e.attention_mask for e in made], "token_type_ids": [e.type_ids for e in made]}
            best = session.run(None, {k: np.array(v, np.int64) for k, v in feeds.items() if k in wanted})[0].argmax(-1)
            return [[(t, s, e, names.get(int(c), "O")) for t, (s, e), c, special in zip(m.tokens, m.offsets, row, m.special_tokens_mask, strict=True) if not special] for m, row in zip(made, best, strict=True)]

        return run

    return load
