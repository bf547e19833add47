"""Indicator lists from CSV or text files, and settings from YAML with defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions.network import indicator_type
from brackwater.sources.logs import read_lines

# Header names that mark the indicator column, the first that is there.
HEADERS = ("indicator", "ioc", "ip", "domain", "hash", "url")


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """indicator and seq (its first place), each indicator once, in file order.

    A path ending in .csv is read by column: the first of HEADERS in the first line, else the first column, whose header cell is
    kept if it is an indicator itself. Any other file has one indicator a line. Lines that begin with # are comments.
    """
    lines = read_lines(spark, path).withColumn("line", F.trim("line")).filter(~F.startswith("line", F.lit("#")))
    if not path.lower().endswith(".csv"):
        values = lines.select("line_number", F.col("line").alias("indicator"))
    else:
        # a cell is all between two quotes, or all up to a comma
        cells = F.transform(F.regexp_extract_all(F.concat("line", F.lit(",")), F.lit('\\s*("(?:[^"]|"")*"|[^,]*)\\s*,'), F.lit(1)), lambda c: F.trim(F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))))
        first = lines.orderBy("line_number").select("line_number", cells.alias("cells")).first()
        names = [c.lower() for c in first["cells"]] if first else []
        at = next((names.index(h) for h in HEADERS if h in names), None)
        values = lines.select("line_number", F.get(cells, F.lit(at or 0)).alias("indicator"))
        if first:
            head = F.col("line_number") == first["line_number"]
            values = values.filter(~head if at is not None else ~head | (indicator_type(F.col("indicator")) != "unknown"))
    values = values.filter((F.coalesce("indicator", F.lit("")) != "") & ~F.startswith("indicator", F.lit("#")))
    return values.groupBy("indicator").agg(F.min("line_number").alias("seq"))


@dataclass(frozen=True)
class Settings:
    """Defaults of the indicator pipeline; API keys come from the environment alone and are not kept here."""

    ttl_hours: float = 24.0
    min_interval_s: float = 15.0
    min_risk: int = 50
    min_confidence: int = 50
    sid_start: int = 1_000_001
    prune_days: int = 90
    tiers: tuple[tuple[str, int], ...] = field(default=(("CRITICAL", 75), ("HIGH", 50), ("SUSPICIOUS", 20)))


def load_settings(text: str | None = None, override: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """Settings from YAML text over the defaults, then from `environ` (BRACKWATER_MIN_RISK and so on), then `override`. Unknown
    keys are an error."""
    found: dict[str, object] = {}
    if text:
        import yaml

        found |= yaml.safe_load(text) or {}
    for f in fields(Settings):
        given = (environ or {}).get(f"BRACKWATER_{f.name.upper()}")
        if given is not None and f.name != "tiers":
            found[f.name] = type(getattr(Settings(), f.name))(given)
    found |= dict(override or {})
    unknown = set(found) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "tiers" in found:
        found["tiers"] = tuple((k, int(v)) for k, v in (found["tiers"].items() if isinstance(found["tiers"], Mapping) else found["tiers"]))
    return replace(Settings(), **found)
