"""Small dimension files and overlays (K1 to K3, S11, S15, S17, R17): JSON on the driver, bounded by hand-kept files."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyglass import schema
from tallyglass.functions import lexicon as L

OVERLAY = "market string, product string, field string, value string, was string, at string, note string, unknown boolean"


def _json(path: str | Path, default):
    """The file's content; ``default`` if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (FileNotFoundError, json.JSONDecodeError, UnicodeDecodeError):
        return default


def markers(path: str | Path, seed: list[str] = L.PROMO_MARKERS, key: str = "markers") -> list[str]:
    """K1: a list that a file may replace; entries and keys that begin with ``_`` are remarks."""
    found = _json(path, {})
    own = [m for m in found.get(key) or [] if m and not str(m).startswith("_")] if isinstance(found, dict) else []
    return own or list(seed)


def knowledge_base(spark: SparkSession, path: str | Path) -> DataFrame:
    """K2: the market dimension; missing lists are empty."""
    rows = []
    for m in (_json(path, {}) or {}).get("markets", []):
        row = {f.name: m.get(f.name) for f in schema.KNOWLEDGE.fields}
        for f in ("handles_alt", "aliases", "choseong_aliases", "products"):
            row[f] = row[f] or []
        rows.append(tuple(row[f.name] for f in schema.KNOWLEDGE.fields))
    return spark.createDataFrame(rows, schema.KNOWLEDGE)


def aliases(spark: SparkSession, path: str | Path) -> DataFrame:
    """K2: (market, alias, canonical)."""
    found = {k: v for k, v in (_json(path, {}) or {}).items() if not k.startswith("_")}
    return spark.createDataFrame([(m, a, c) for m, own in found.items() for a, c in own.items()], "market string, alias string, canonical string")


def overlay(spark: SparkSession, path: str | Path) -> DataFrame:
    """K3: human edits as a long table."""
    rows = [
        (m, p, f, e.get("value"), e.get("was"), e.get("at"), e.get("note"), bool(e.get("unknown", False)))
        for m, products in (_json(path, {}) or {}).items() if not m.startswith("_")
        for p, fields in products.items() for f, e in fields.items()
    ]
    return spark.createDataFrame(rows, OVERLAY)


def save_json(path: str | Path, content) -> None:
    """Written beside the target and moved over it, so a reader never sees half a file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(content, f, ensure_ascii=False, indent=1)
    os.replace(name, path)


def record(path: str | Path, market: str, product: str, field: str, value: str | None, was: str | None, at: str, unknown: bool = False) -> None:
    """One human edit added to the overlay file, with the value it replaces."""
    found = _json(path, {})
    found.setdefault(market, {}).setdefault(product, {})[field] = {"value": (value or "").strip() or None, "was": was, "at": at, "unknown": unknown}
    save_json(path, found)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The stored product registry; empty where it is missing."""
    columns = "market string, tag string, n_posts long, n_total long, class string"
    try:
        return spark.read.schema(columns).parquet(path).where("class = 'product'")
    except Exception as error:  # noqa: BLE001  Spark has no narrower class for it in Python
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], columns)


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three tables of the review domain."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("specs", "reviews", "review_summaries")}
