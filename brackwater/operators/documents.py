"""Validation of nested JSON documents against declared rules, with all violations of a document.

Rules come from a JSON Schema (`load_schema`) or from the declared table `RULES`. A path may pass through arrays: `a[].b` is
the field b of each item of a. Every check is a projection over variant values; nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions.scalars import let


@dataclass(frozen=True)
class Rule:
    path: str
    type: str  # object, array, string, number
    required: bool = False
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    min_items: int = 0


# The declared document, one rule for each field and each kind of item.
RULES = (
    Rule("event", "object", True),
    Rule("event.event_id", "string", True),
    Rule("event.timestamp", "string", True),
    Rule("event.source", "string", True),
    Rule("event.event_type", "string", True, ("firewall", "auth", "dns", "web", "system")),
    Rule("event.severity", "string", True, ("low", "medium", "high", "critical")),
    Rule("enrichment", "object"),
    Rule("enrichment.threat_intel_matches", "array"),
    Rule("enrichment.threat_intel_matches[]", "object"),
    Rule("enrichment.threat_intel_matches[].indicator", "string", True),
    Rule("enrichment.threat_intel_matches[].source", "string", True),
    Rule("enrichment.threat_intel_matches[].threat_type", "string", True),
    Rule("enrichment.asset_context", "object"),
    Rule("enrichment.asset_context.owner", "string"),
    Rule("enrichment.asset_context.environment", "string", False, ("production", "staging", "development")),
    Rule("enrichment.asset_context.criticality", "string", False, ("low", "medium", "high", "mission-critical")),
    Rule("enrichment.related_events", "array"),
    Rule("enrichment.related_events[]", "string"),
    Rule("confidence", "object", True),
    Rule("confidence.score", "number", True, low=0.0, high=1.0),
    Rule("confidence.scale", "string", True, ("0.0-1.0",)),
    Rule("confidence.applies_to", "array", True, min_items=1),
    Rule("confidence.applies_to[]", "string"),
    Rule("approval", "object", True),
    Rule("approval.approval_status", "string", True, ("pending", "approved", "rejected", "auto-approved")),
    Rule("approval.approver_id", "string", True),
    Rule("approval.approval_timestamp", "string", True),
    Rule("audit_trail", "array", True),
    Rule("audit_trail[]", "object"),
    Rule("audit_trail[].actor", "object", True),
    Rule("audit_trail[].actor.id", "string", True),
    Rule("audit_trail[].actor.type", "string", True, ("human", "system")),
    Rule("audit_trail[].action", "string", True),
    Rule("audit_trail[].timestamp", "string", True),
)
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "number": "^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)"}
_USED = {"type", "required", "properties", "items", "enum", "minimum", "maximum", "minItems"}
_NOTES = {"$schema", "$id", "$comment", "title", "description", "format", "default", "examples"}


def rules_of(schema: Mapping, path: str = "", required: bool = False) -> Iterator[Rule]:
    """One rule for each node of a JSON Schema below its root, parents first. Formats are notes, not checks; a keyword that
    is neither used here nor a note is an error."""
    unknown = set(schema) - _USED - _NOTES
    if unknown:
        raise ValueError(f"{path or 'the schema'} uses {', '.join(sorted(unknown))}")
    if path:
        if schema.get("type") not in _KINDS:
            raise ValueError(f"{path} has no type of {', '.join(_KINDS)}")
        yield Rule(path, schema["type"], required, tuple(schema.get("enum", ())), schema.get("minimum"), schema.get("maximum"), schema.get("minItems", 0))
    needed = schema.get("required", ())
    missing = set(needed) - set(schema.get("properties", {}))
    if missing:
        raise ValueError(f"{path or 'the schema'} requires undeclared fields: {', '.join(sorted(missing))}")
    for name, own in schema.get("properties", {}).items():
        yield from rules_of(own, f"{path}.{name}" if path else name, name in needed)
    if "items" in schema:
        yield from rules_of(schema["items"], f"{path}[]")


def load_schema(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of a JSON Schema file that Spark can read. A file that is missing, or no JSON object, is an error."""
    text = spark.read.text(path, wholetext=True).first()
    schema = json.loads(text[0]) if text else None
    if not isinstance(schema, dict):
        raise ValueError(f"{path} holds no JSON Schema")
    return tuple(rules_of(schema))


@dataclass
class _Node:
    rule: Rule
    fields: dict[str, _Node]
    item: _Node | None = None

    def paths(self) -> list[str]:
        below = [*self.fields.values(), *([self.item] if self.item else [])]
        return [self.rule.path, *(p for n in below for p in n.paths())]


def _tree(rules: tuple[Rule, ...]) -> dict[str, _Node]:
    """The nodes of the top fields; a rule comes after that of the object or array which holds it."""
    nodes: dict[str, _Node] = {"": _Node(Rule("", "object"), {})}
    for r in rules:
        above = r.path[:-2] if r.path.endswith("[]") else r.path.rpartition(".")[0]
        nodes[r.path] = own = _Node(r, {})
        if r.path.endswith("[]"):
            nodes[above].item = own
        else:
            nodes[above].fields[r.path.rpartition(".")[2]] = own
    return nodes[""].fields


_LIST = "array<variant>"


def _child(value: Column, *names: str) -> Column:
    """The field of an object down a path of names; null where there is none."""
    return F.try_variant_get(value, "$" + "".join(f'["{n}"]' for n in names), "variant")


def _shape(value: Column, rule: Rule) -> Column:
    """Null where the type is wrong; the items of an array, else true. Objects are told by a cast that reads no field, as
    their schema would be built from all that they hold."""
    if rule.type == "array":
        return F.try_variant_get(value, "$", _LIST)
    if rule.type == "object":
        return F.when(F.try_variant_get(value, "$", "struct<>").isNotNull(), F.lit(True))
    return F.when(F.schema_of_variant(value).rlike(_KINDS[rule.type]), F.lit(True))


def _fault(value: Column, shape: Column, owned: Column, rule: Rule) -> Column:
    """Kind of the first violation of one value, or null."""
    there = value.isNotNull()
    out = F.when(owned & ~there, F.lit("required")) if rule.required else F.when(F.lit(False), F.lit(""))
    out = out.when(there & shape.isNull(), "type")
    if rule.values:
        out = out.when(there & ~F.try_variant_get(value, "$", "string").isin(*rule.values), "enum")
    if rule.low is not None or rule.high is not None:
        number = F.try_variant_get(value, "$", "double")
        outside = [number < rule.low] if rule.low is not None else []
        outside += [number > rule.high] if rule.high is not None else []
        out = out.when(there & (outside[0] | outside[-1]), "range")
    if rule.min_items:
        out = out.when(F.size(shape) < rule.min_items, "items")
    return out


def _item_faults(value: Column, owned: Column, node: _Node, named: bool = False) -> Column:
    """The kind of violation, or null, of an item and of all below it, in the order of `paths`; each value is taken out once.
    `named`: the value is a lambda's variable already. The shape of a value that holds no others is used once and needs no name."""

    def with_shape(v: Column, s: Column) -> Column:
        parts = [F.array(_fault(v, s, owned, node.rule))]
        parts += [_item_faults(_child(v, name), s.isNotNull(), own) for name, own in node.fields.items()]
        parts += [_first_faults(s, node.item)] if node.item else []
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def shaped(v: Column) -> Column:
        if not node.fields and not node.item:
            return with_shape(v, _shape(v, node.rule))
        return let({"s": _shape(v, node.rule)}, lambda c: with_shape(v, c["s"]))

    return shaped(value) if named else let({"v": value}, lambda b: shaped(b["v"]))


def _first_faults(items: Column, node: _Node) -> Column:
    """The first fault of each rule among the items of an array."""
    size = len(node.paths())
    rows = F.transform(F.coalesce(items, F.array().cast(_LIST)), lambda x: _item_faults(x, F.lit(True), node, named=True))
    first = lambda r, i: F.get(F.filter(F.transform(r, lambda row: row[i]), lambda k: k.isNotNull()), F.lit(0))
    return let({"r": rows}, lambda b: F.array(*[first(b["r"], i) for i in range(size)]))


def validate(docs: DataFrame, json: str = "json", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns, `violations` ('path: kind', in the order of the rules; empty for a valid document) and `valid`. Text that
    is no JSON object has the one violation 'json'; null text as well. Of the items of an array the first fault of each rule
    counts. A field inside something that is no object breaks no rule of its own; formats are not checked, and further keys
    are allowed.

    Values outside arrays, and then their shapes, are columns of their own, so all their checks are compiled; only items of
    arrays go through lambdas.
    """
    kept = docs.columns
    nodes: list[tuple[_Node, tuple[str, ...], str]] = []  # with the names above and the column of the holder's shape

    def walk(fields: dict[str, _Node], above: tuple[str, ...], holder: str) -> None:
        for name, node in fields.items():
            nodes.append((node, (*above, name), holder))
            walk(node.fields, (*above, name), f"_brackwater_s{len(nodes) - 1}")

    walk(_tree(rules), (), "_brackwater_root")
    parsed = docs.withColumn("_brackwater_doc", F.try_parse_json(json))
    root = _shape(F.col("_brackwater_doc"), Rule("", "object"))
    values = parsed.select("*", root.alias("_brackwater_root"), *[_child(F.col("_brackwater_doc"), *path).alias(f"_brackwater_v{i}") for i, (_, path, _) in enumerate(nodes)])
    shapes = values.select("*", *[_shape(F.col(f"_brackwater_v{i}"), node.rule).alias(f"_brackwater_s{i}") for i, (node, _, _) in enumerate(nodes)])
    parts, some = [], []

    def named(kind: Column, path: str) -> Column:
        return F.concat(F.lit(f"{path}: "), kind)

    def named_items(kinds: Column, paths: list[str]) -> Column:
        names = F.array(*[F.lit(f"{p}: ") for p in paths])
        return F.transform(kinds, lambda k, j: F.concat(F.get(names, j), k))

    for i, (node, _, holder) in enumerate(nodes):
        v, s = F.col(f"_brackwater_v{i}"), F.col(f"_brackwater_s{i}")
        some.append(named(_fault(v, s, F.col(holder).isNotNull(), node.rule), node.rule.path))
        if node.item:
            # an array that is missing or empty has no items to look at
            found = F.when(F.size(s) > 0, named_items(_first_faults(s, node.item), node.item.paths()))
            parts += [F.array(*some), F.coalesce(found, F.array().cast("array<string>"))]
            some = []
    parts += [F.array(*some)] if some else []
    violations = F.filter(F.concat(*parts), lambda v: v.isNotNull())
    out = shapes.select(*kept, F.when(F.col("_brackwater_root").isNotNull(), violations).otherwise(F.array(F.lit("json"))).alias("violations"))
    return out.withColumn("valid", F.size("violations") == 0)
