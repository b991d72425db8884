"""Codebooks: declared schemas of annotations.

A codebook is a mapping with id, version, title and dimensions; a dimension has
name, scale (nominal, ordinal), required, conditional_on (a dimension, or a mapping
of dimension and in, the codes it must have), score_aggregation,
allow_multiple_values and categories; a category has code, label, definition
and, for ordinal scales, value. Replies are checked in ``replies``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALES, AGGREGATIONS = ("nominal", "ordinal"), ("max", "min", "mean", "first")
KEYS = {"codebook": {"id", "version", "title", "unit", "dimensions", "description", "max_annotations", "allow_multiple_annotations", "evidence_required", "notes"}, "dimension": {"name", "scale", "required", "conditional_on", "score_aggregation", "allow_multiple_values", "categories", "description"}, "category": {"code", "value", "label", "definition", "examples", "excludes"}}


class CodebookError(ValueError):
    pass


@dataclass(frozen=True)
class Dimension:
    name: str
    codes: tuple[str, ...]
    scale: str = "nominal"
    required: bool = True
    conditional_on: str | None = None
    aggregation: str = "max"
    values: dict[str, int] = field(default_factory=dict)
    multiple: bool = False
    conditional_in: tuple[str, ...] = ()

    @property
    def allows_none(self) -> bool:
        return not self.required or self.conditional_on is not None


@dataclass(frozen=True)
class Codebook:
    id: str
    version: int
    dimensions: tuple[Dimension, ...]
    max_annotations: int = 4
    evidence_required: bool = True
    warnings: tuple[str, ...] = ()

    def codes(self) -> dict[str, tuple[str, ...]]:
        return {d.name: d.codes for d in self.dimensions}

    def rows(self, spark) -> DataFrame:
        """(codebook, dimension, code, value, ordinal_pos)."""
        return spark.createDataFrame([(self.id, d.name, c, d.values.get(c), i) for d in self.dimensions for i, c in enumerate(d.codes)], "codebook string, dimension string, code string, value int, ordinal_pos int")


def _strangers(raw: dict, kind: str, where: str, warnings: list[str]) -> None:
    for k in raw:
        if k not in KEYS[kind]:
            warnings.append(f"{where}: unknown key {k!r}")


def load_yaml(path: str) -> Codebook:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))


def parse(raw: dict) -> Codebook:
    """Raises CodebookError with every fault found, each with its place."""
    errors, warnings, dims = [], [], []
    if not isinstance(raw, dict):
        raise CodebookError("a codebook is a mapping")
    _strangers(raw, "codebook", "codebook", warnings)
    for k, kind in (("id", str), ("version", int), ("dimensions", list)):
        if not isinstance(raw.get(k), kind) or raw.get(k) in ("", []):
            errors.append(f"codebook: {k} must be a {kind.__name__} and not empty")
    seen: set[str] = set()
    for i, d in enumerate(raw.get("dimensions") or []):
        at = f"dimensions[{i}]"
        _strangers(d, "dimension", at, warnings)
        name, scale, cats = d.get("name"), d.get("scale", "nominal"), d.get("categories") or []
        if not name or name in seen:
            errors.append(f"{at}: name is missing or repeats")
        seen.add(name)
        if scale not in SCALES:
            errors.append(f"{at}: scale {scale!r}")
        if d.get("score_aggregation", "max") not in AGGREGATIONS:
            errors.append(f"{at}: score_aggregation {d['score_aggregation']!r}")
        codes = [c.get("code") for c in cats]
        for j, c in enumerate(cats):
            _strangers(c, "category", f"{at}.categories[{j}]", warnings)
            if not c.get("definition"):
                warnings.append(f"{at}.categories[{j}]: no definition")
        if not codes or None in codes or len(set(codes)) < len(codes):
            errors.append(f"{at}: codes must be given and differ")
        if "NONE" in codes:
            errors.append(f"{at}: NONE is reserved")
        values = {c.get("code"): c.get("value") for c in cats if scale == "ordinal"}
        if scale == "ordinal":
            v = list(values.values())
            if any(not isinstance(x, int) or isinstance(x, bool) for x in v):
                errors.append(f"{at}: every category of an ordinal scale needs a whole value")
            elif len(set(v)) < len(v):
                errors.append(f"{at}: values repeat")
            elif sorted(v) != list(range(min(v), min(v) + len(v))):
                warnings.append(f"{at}: values have gaps")
        for a, b in ((a, b) for i, a in enumerate(cats) for b in cats[i + 1 :]):
            x, y = ({w for w in str(c.get("definition", "")).lower().split() if len(w) > 2} for c in (a, b))
            if x and y and len(x & y) / len(x | y) >= 0.5:
                warnings.append(f"{at}: definitions of {a.get('code')} and {b.get('code')} overlap")
        on = d.get("conditional_on")
        on, only = (on.get("dimension"), tuple(on.get("in") or ())) if isinstance(on, dict) else (on, ())
        dims.append(Dimension(name or "", tuple(c or "" for c in codes), scale, bool(d.get("required", True)), on, d.get("score_aggregation", "max"), values, bool(d.get("allow_multiple_values", False)), only))
    parent = {d.name: d.conditional_on for d in dims}
    for d in dims:
        if d.conditional_on and d.conditional_on not in parent:
            errors.append(f"{d.name}: conditional_on {d.conditional_on!r} is no dimension")
        strange = set(d.conditional_in) - {c for other in dims if other.name == d.conditional_on for c in other.codes}
        if strange:
            errors.append(f"{d.name}: conditional_on names no codes {sorted(strange)}")
        x, met = d.name, set()
        while x and x not in met:
            met.add(x)
            x = parent.get(x)
        if x:
            errors.append(f"{d.name}: conditional_on runs in a circle")
    if errors:
        raise CodebookError("; ".join(errors))
    return Codebook(raw["id"], raw["version"], tuple(dims), int(raw.get("max_annotations", 4)) if raw.get("allow_multiple_annotations", True) else 1, bool(raw.get("evidence_required", True)), tuple(warnings))


def speech_blocks(units: DataFrame) -> DataFrame:
    """The numbered paragraphs of each speech as one text, in order."""
    line = F.concat(F.lit("["), (F.row_number().over(_order())).cast("string"), F.lit("] "), F.col("text"))
    from .ordered import joined_in_order

    return units.withColumn("_l", line).groupBy("speech_id").agg(joined_in_order("_l", ["para_index"], "\n").alias("block"), F.count(F.lit(1)).alias("n_units"))


def _order():
    from pyspark.sql.window import Window as W

    return W.partitionBy("speech_id").orderBy("para_index")


def prompt(cb: Codebook) -> str:
    """The part of a request that all speeches share: the same text for the same codebook."""
    out = [f"Codebook {cb.id}, version {cb.version}. Answer with one JSON object: a key for each paragraph, a list of annotations under it."]
    for d in cb.dimensions:
        note = f"; only with {d.conditional_on}" if d.conditional_on else "; NONE is allowed" if d.allows_none else ""
        out.append(f"{d.name} ({d.scale}{note}): {', '.join(d.codes)}")
    return "\n".join(out)
