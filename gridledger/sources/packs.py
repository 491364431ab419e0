"""Document-type packs and checklists: YAML or JSON files, checked whole, as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Kinds of a field's value, and roots of its path.
KINDS = ("money", "quantity", "rate", "percent", "date", "duration", "text", "enum", "boolean", "list")
ROOTS = ("identity", "economic", "technical", "commercial", "legal", "regulatory", "frame")
SCHEMA = "pack_code string, version string, key string, path string, path_root string, value_kind string, required boolean, synonyms array<string>"


def parse(text: str) -> dict:
    """A pack's tree: JSON, or YAML where a YAML reader is installed."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("a YAML reader is needed for packs that are not JSON") from e
    return yaml.safe_load(text)


def faults(pack: dict) -> list[str]:
    """Everything that is wrong with a pack; a pack with any fault is refused whole."""
    out = [f"{k} is missing" for k in ("code", "version") if not pack.get(k)]
    seen = set()
    for f in pack.get("fields") or []:
        key = f.get("key")
        if not key:
            out.append("a field has no key")
        elif key in seen:
            out.append(f"field {key} stands twice")
        seen.add(key)
        if f.get("value_kind") not in KINDS:
            out.append(f"field {key}: unknown kind {f.get('value_kind')}")
        if f.get("path_root") is not None and f["path_root"] not in ROOTS:
            out.append(f"field {key}: unknown root {f['path_root']}")
    return out


def fields(spark: SparkSession, packs: list[dict]) -> DataFrame:
    """pack_field rows of sound packs; a fault raises with all faults named."""
    wrong = {p.get("code"): x for p in packs if (x := faults(p))}
    if wrong:
        raise ValueError(f"packs refused: {wrong}")
    rows = [(p["code"], str(p["version"]), f["key"], f.get("path"), f.get("path_root"), f["value_kind"], bool(f.get("required")), list(f.get("synonyms") or [])) for p in packs for f in p.get("fields") or []]
    return spark.createDataFrame(rows, SCHEMA)


def json_schema(pack: dict) -> dict:
    """The JSON schema of what a pack's fields and tables extract to: value, quote and page for each."""
    leaf = lambda kind: {"type": "object", "properties": {"value": {"type": "string", "x-kind": kind}, "quote": {"type": "string"}, "page": {"type": "integer"}}}
    own = {f["key"]: leaf(f["value_kind"]) for f in pack.get("fields") or []}
    tables = {t["name"]: {"type": "array", "items": {"type": "object", "properties": {f["key"]: leaf(f["value_kind"]) for f in t.get("fields") or []}}} for t in pack.get("tables") or []}
    return {"type": "object", "title": pack.get("code"), "properties": own | tables, "required": [f["key"] for f in pack.get("fields") or [] if f.get("required")]}
