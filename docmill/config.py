"""Settings with their defaults, the ontology file, and limits of known models."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Every default can be replaced by name."""

    parent_tokens: int = 512
    child_tokens: int = 64
    sentence_buffer: int = 5
    breakpoint_method: str = "percentile"
    breakpoint_amount: float = 0.95
    table_tokens: int = 512
    table_overlap: float = 0.25
    top_k: int = 10
    reranked: int = 5
    dense_weight: float = 0.6
    type_weights: tuple[tuple[str, float], ...] = (("text", 1.0), ("table", 0.9), ("image", 0.8))
    chunks_per_entity: int = 20
    chunks_from_graph: int = 100
    cache_size: int = 50
    cache_ttl: int = 300
    cache_similarity: float = 0.92
    skip_below: float = 0.15
    fallback_below: float = 0.3
    traversal_depth: int = 2
    paths: int = 10
    communities: int = 3
    resolution: float = 1.0
    same_entity_similarity: float = 0.75
    same_entity_confidence: float = 0.7
    quota_streak: int = 5
    strategy: str = "hybrid"
    rerank: bool = True
    lost_in_middle: bool = True
    compression: bool = False


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    description: str = ""


@dataclass(frozen=True)
class EntityType:
    name: str
    description: str = ""
    examples: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class RelationType:
    name: str
    description: str = ""
    source_types: tuple[str, ...] = ()
    target_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ontology:
    domain: str = "General Knowledge Base"
    language: str = "en"
    entities: tuple[EntityType, ...] = ()
    relations: tuple[RelationType, ...] = ()
    max_entities: int = 15
    max_relations: int = 20
    min_confidence: float = 0.7
    community_resolution: float = 1.0
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)


def ontology_of(data: dict | None) -> Ontology:
    """From a parsed file; attributes may be names or records, weights stand under query_weights or query_routing."""
    d = data or {}
    get = lambda part: d.get(part) or {}
    attribute = lambda a: Attribute(a) if isinstance(a, str) else Attribute(a.get("name", ""), a.get("type", "string"), a.get("description", ""))
    entity = lambda e: EntityType(e.get("name", ""), e.get("description", ""), tuple(e.get("examples") or ()), tuple(attribute(a) for a in e.get("attributes") or ()))
    first = lambda r, *names: tuple(next((r[n] for n in names if r.get(n)), ()))
    relation = lambda r: RelationType(r.get("name", ""), r.get("description", ""), first(r, "source_types", "valid_source"), first(r, "target_types", "valid_target"))
    routing = get("query_weights") or get("query_routing")
    return Ontology(
        get("domain").get("name", "General Knowledge Base"),
        get("domain").get("language", "en"),
        tuple(entity(e) for e in d.get("entities") or ()),
        tuple(relation(r) for r in d.get("relationships") or ()),
        get("extraction").get("max_entities_per_chunk", 15),
        get("extraction").get("max_relationships_per_chunk", 20),
        get("extraction").get("min_confidence", 0.7),
        get("graph").get("community_resolution", get("graph").get("resolution", 1.0)),
        {k: (float(w.get("vector", 0.5)), float(w.get("graph", 0.5))) for k, w in routing.items() if isinstance(w, dict)},
    )


def load_ontology(path: str) -> Ontology:
    """From a YAML file; the defaults where there is none."""
    p = Path(path)
    if not p.exists():
        return Ontology()
    import yaml

    return ontology_of(yaml.safe_load(p.read_text(encoding="utf-8")))


# Context window and dimension of embedding models.
EMBEDDING_MODELS = {
    "qwen3-embedding:0.6b": (8192, 1024), "qwen3-embedding:4b": (8192, 2560), "nomic-embed-text": (8192, 768), "text-embedding-3-small": (8191, 1536),
    "text-embedding-3-large": (8191, 3072), "text-embedding-004": (2048, 768),
}
DEFAULT_EMBEDDING = (8192, 1024)


def embedding_limits(model: str) -> tuple[int, int]:
    """(context window, dimension): by name, else by the part before a tag, else the default."""
    if model in EMBEDDING_MODELS:
        return EMBEDDING_MODELS[model]
    return next((v for k, v in EMBEDDING_MODELS.items() if model.startswith(k.split(":")[0])), DEFAULT_EMBEDDING)


def settings_of(**changes) -> Settings:
    unknown = set(changes) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**changes)


def settings_from(spark, prefix: str = "spark.docmill.", **changes) -> Settings:
    """Settings out of the session's configuration (``spark.docmill.top_k`` and so on), then ``changes``."""
    found = {}
    for f in fields(Settings):
        text = spark.conf.get(prefix + f.name, None)
        if text is None or f.name == "type_weights":
            continue
        kind = type(f.default)
        found[f.name] = text.strip().lower() in ("true", "1", "yes") if kind is bool else kind(text)
    return settings_of(**{**found, **changes})
