"""Engine options: one frozen record, read from a mapping or from a JSON or YAML document."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import Enum


class ConflictStrategy(str, Enum):
    """How overlapping spans are ordered before the sweep."""

    REGEX_PRIORITY = "REGEX_PRIORITY"
    LONGEST_WINS = "LONGEST_WINS"

    @classmethod
    def parse(cls, name: str | None) -> ConflictStrategy:
        """Unknown or missing names mean LONGEST_WINS."""
        return cls.__members__.get((name or "").strip().upper(), cls.LONGEST_WINS)


DEFAULT_FILTERS = ("email", "phone", "credit_card", "ip_address")


@dataclass(frozen=True)
class Provider:
    """An endpoint that requests may name."""

    id: str
    host: str
    port: int = 443
    codec: str = "openai"


@dataclass(frozen=True)
class Config:
    filters: tuple[str, ...] = DEFAULT_FILTERS
    conflict_strategy: ConflictStrategy = ConflictStrategy.LONGEST_WINS
    resolution: str = "jaro-winkler"
    resolution_enabled: bool = True
    threshold: float = 0.88
    #: Types that are matched by similarity; all others exactly. None: every type.
    fuzzy_types: tuple[str, ...] | None = ("PERSON", "LOCATION", "ORGANIZATION")
    gateway_prompt: str = ""
    ml_model_directory: str | None = None
    ml_output_adapter: str = "BIO"
    ml_ignored_tags: tuple[str, ...] = ()
    ml_tag_mapping: dict[str, str] = field(default_factory=dict)
    ml_batch_size: int = 16
    ml_batch_timeout_ms: int = 10
    ml_max_queue_size: int = 1000
    ml_intra_op_threads: int = 1
    on_ml_error: str = "skip"
    providers: tuple[Provider, ...] = ()
    storage_path: str = "./data/state"
    logging_level: str = "INFO"
    server_port: int = 8080

    def __post_init__(self):
        for name in self.ml_tag_mapping.values():
            if not re.fullmatch(r"[A-Z_]+", name):
                raise ValueError(f"tag names have only A-Z and _, else tags can't be found again: {name}")
        if self.on_ml_error not in ("skip", "fail"):
            raise ValueError(f"on_ml_error is skip or fail, not {self.on_ml_error}")

    @classmethod
    def from_mapping(cls, tree: dict) -> Config:
        """The nested layout: providers, storage, logging, ml, pipeline (filters, entity_resolution)."""
        pipe, ml = tree.get("pipeline") or {}, tree.get("ml") or {}
        matching = pipe.get("entity_resolution") or {}
        names = pipe.get("filters", {})
        if isinstance(names, dict) and "names" in names:
            filters = tuple(names["names"])
        elif isinstance(names, dict):  # the older layout: a switch for each filter, all on
            filters = tuple(n for n in DEFAULT_FILTERS if names.get(n, True))
        else:
            filters = tuple(names)
        given = matching.get("fuzzy_types")
        return cls(
            filters=filters, conflict_strategy=ConflictStrategy.parse(pipe.get("conflict_strategy")),
            resolution=matching.get("algorithm", "jaro-winkler"), resolution_enabled=matching.get("enabled", True), threshold=float(matching.get("threshold", 0.88)),
            fuzzy_types=cls.fuzzy_types if given is None else tuple(given), gateway_prompt=pipe.get("gateway_system_prompt", ""),
            ml_model_directory=ml.get("model_directory"), ml_output_adapter=ml.get("output_adapter", "BIO"), ml_ignored_tags=tuple(ml.get("ignored_tags", ())), ml_tag_mapping=dict(ml.get("tag_mapping") or {}),
            ml_batch_size=int(ml.get("batch_size", 16)), ml_batch_timeout_ms=int(ml.get("batch_timeout_ms", 10)), ml_max_queue_size=int(ml.get("max_queue_size", 1000)), ml_intra_op_threads=int(ml.get("intra_op_threads", 1)),
            providers=tuple(Provider(k, v.get("host", ""), int(v.get("port", 443)), v.get("codec", "openai")) for k, v in (tree.get("providers") or {}).items()),
            storage_path=(tree.get("storage") or {}).get("path", "./data/state"), logging_level=(tree.get("logging") or {}).get("level", "INFO"), server_port=int((tree.get("server") or {}).get("port", 8080)),
        )

    @classmethod
    def load(cls, path: str) -> Config:
        """From a .json file, or a .yaml one where a YAML reader is installed."""
        with open(path, encoding="utf-8") as text:
            if path.endswith(".json"):
                return cls.from_mapping(json.load(text))
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("no YAML reader is installed: give the options as JSON") from e
            return cls.from_mapping(yaml.safe_load(text) or {})
