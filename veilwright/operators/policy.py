"""Policies: which findings count, what replaces them and what may be applied without review."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import FINDING, with_fields
from .rules import PLACEHOLDERS

POLICY_SCHEMA = (
    "schema_version int, id string, auto_apply_min_confidence float, scan_markdown_code boolean, "
    "entities map<string,struct<enabled:boolean,auto_apply:boolean,replacement:string>>, "
    "detectors array<struct<id:string,enabled:boolean,required:boolean,priority:smallint,min_confidence:float>>, "
    "exact_terms array<struct<value:string,entity_type:string>>, allowlist array<string>, "
    "image_mask struct<safety_margin_px:int,solid_rgb:array<int>,auto_apply_min_ocr_confidence:float>, "
    "replacement_mapping struct<scope:string,reversible:boolean,key_reference:string>"
)


@dataclass(frozen=True)
class Entity:
    enabled: bool = True
    auto_apply: bool = True
    replacement: str = ""


@dataclass(frozen=True)
class Detector:
    id: str
    enabled: bool = True
    required: bool = False
    priority: int = 0
    min_confidence: float = 0.0


@dataclass(frozen=True)
class ImageMask:
    safety_margin_px: int = 4
    solid_rgb: tuple[int, int, int] = (0, 0, 0)
    auto_apply_min_ocr_confidence: float = 0.90


@dataclass(frozen=True)
class Mapping:
    scope: str = "task"
    reversible: bool = False
    key_reference: str | None = None


@dataclass(frozen=True)
class Policy:
    """The default keeps recall high: all entities are enabled and applied at a confidence of 0.9."""

    schema_version: int = 1
    id: str = "default-high-recall"
    auto_apply_min_confidence: float = 0.90
    scan_markdown_code: bool = True
    entities: dict[str, Entity] = field(default_factory=lambda: {k: Entity(replacement=v) for k, v in PLACEHOLDERS.items()})
    detectors: tuple[Detector, ...] = (Detector("siamese_uie", priority=50, min_confidence=0.65), Detector("qwen_review", priority=30, min_confidence=0.70))
    exact_terms: tuple[tuple[str, str], ...] = ()
    allowlist: tuple[str, ...] = ()
    image_mask: ImageMask = ImageMask()
    replacement_mapping: Mapping = Mapping()

    def to_json(self) -> str:
        data = asdict(self)
        data["exact_terms"] = [{"value": v, "entity_type": e} for v, e in self.exact_terms]
        return json.dumps(data, ensure_ascii=False)


#: Fields that a policy file may leave out; any other missing field is an error.
OPTIONAL = ("exact_terms", "allowlist", "image_mask")


def parse_policy(text: str) -> Policy:
    data = json.loads(text)
    missing = [f for f in Policy.__dataclass_fields__ if f not in data and f not in OPTIONAL]
    if missing:
        raise ValueError(f"policy lacks {', '.join(missing)}")
    unknown = [e for e in data["entities"] if e not in PLACEHOLDERS]
    if unknown:
        raise ValueError(f"unknown entity {unknown[0]}")
    policy = Policy(
        data["schema_version"],
        data["id"],
        data["auto_apply_min_confidence"],
        data["scan_markdown_code"],
        {k: Entity(v["enabled"], v["auto_apply"], v["replacement"]) for k, v in data["entities"].items()},
        tuple(Detector(d["id"], d["enabled"], d["required"], d["priority"], d["min_confidence"]) for d in data["detectors"]),
        tuple((t["value"], t["entity_type"]) for t in data.get("exact_terms", [])),
        tuple(data.get("allowlist", [])),
        ImageMask(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.get("image_mask", {}).items()}),
        Mapping(**data["replacement_mapping"]),
    )
    return policy


def load_policy(path: str | Path) -> Policy:
    policy = parse_policy(Path(path).read_text(encoding="utf-8"))
    found = violations(policy)
    if found:
        raise ValueError(f"policy {policy.id!r}: {found[0][0]} {found[0][1]}".strip())
    return policy


def violations(policy: Policy) -> list[tuple[str, str]]:
    """(code, what) of all that is wrong, in the order of checking; none for a usable policy."""
    fraction = lambda x: isinstance(x, (int, float)) and 0 <= x <= 1
    found: list[tuple[str, str]] = []
    add = lambda wrong, code, what="": found.append((code, what)) if wrong else None
    add(policy.schema_version != 1, "UNSUPPORTED_SCHEMA")
    add(not policy.id.strip(), "EMPTY_ID")
    add(not fraction(policy.auto_apply_min_confidence), "INVALID_AUTO_APPLY_CONFIDENCE")
    seen: Counter[str] = Counter()
    for d in policy.detectors:
        add(not d.id.strip(), "EMPTY_DETECTOR_ID")
        add(seen[d.id], "DUPLICATE_DETECTOR", d.id)
        add(not fraction(d.min_confidence), "INVALID_DETECTOR_CONFIDENCE", d.id)
        seen[d.id] += 1
    for name, entity in policy.entities.items():
        add(len(entity.replacement) > 256, "REPLACEMENT_TOO_LONG", name)
    terms: Counter[tuple[str, str]] = Counter()
    for value, entity in policy.exact_terms:
        add(not 0 < len(value) <= 256, "INVALID_EXACT_TERM")
        add(terms[(value, entity)], "DUPLICATE_EXACT_TERM", value)
        terms[(value, entity)] += 1
    kept: Counter[str] = Counter()
    for value in policy.allowlist:
        add(not 0 < len(value) <= 256, "INVALID_ALLOWLIST_VALUE")
        add(kept[value], "DUPLICATE_ALLOWLIST_VALUE", value)
        kept[value] += 1
    mapping = policy.replacement_mapping
    add(mapping.reversible and not (mapping.key_reference or "").strip(), "MISSING_KEY_REFERENCE")
    add(mapping.reversible, "REVERSIBLE_MAPPING_NOT_IMPLEMENTED")
    add(mapping.scope in ("project", "global"), "PERSISTENT_MAPPING_NOT_IMPLEMENTED")
    add(policy.image_mask.safety_margin_px > 128, "IMAGE_MARGIN_TOO_LARGE")
    add(not fraction(policy.image_mask.auto_apply_min_ocr_confidence), "INVALID_IMAGE_OCR_CONFIDENCE")
    return found


def policy_violations(policies: DataFrame, key: str = "id") -> DataFrame:
    """policies (id and the columns of POLICY_SCHEMA): one row (key, code, what) for each thing that is wrong."""
    fraction = lambda c: c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    sized = lambda c: F.length(c).between(1, 256)
    none = F.array().cast("array<struct<code:string,what:string>>")

    def fail(wrong: Column, code: str) -> Column:
        return F.when(wrong, F.array(F.struct(F.lit(code).alias("code"), F.lit("").alias("what")))).otherwise(none)

    def each(items: Column, wrong, code: str, what) -> Column:
        return F.transform(F.filter(items, wrong), lambda x: F.struct(F.lit(code).alias("code"), what(x).alias("what")))

    def repeated(items: Column, code: str, what) -> Column:
        numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        again = F.filter(numbered, lambda n: F.array_contains(F.slice(items, F.lit(1), n["i"]), n["x"]))
        return F.transform(again, lambda n: F.struct(F.lit(code).alias("code"), what(n["x"]).alias("what")))

    mapping, empty = F.col("replacement_mapping"), lambda x: F.lit("")
    terms, allowed, detectors = F.col("exact_terms"), F.col("allowlist"), F.col("detectors")
    ids = F.transform(detectors, lambda d: d["id"])
    names = F.map_entries("entities")
    checks = [
        fail(F.col("schema_version") != 1, "UNSUPPORTED_SCHEMA"),
        fail(blank(F.col("id")), "EMPTY_ID"),
        fail(~fraction(F.col("auto_apply_min_confidence")), "INVALID_AUTO_APPLY_CONFIDENCE"),
        each(ids, blank, "EMPTY_DETECTOR_ID", empty),
        repeated(ids, "DUPLICATE_DETECTOR", lambda x: x),
        each(detectors, lambda d: ~fraction(d["min_confidence"]), "INVALID_DETECTOR_CONFIDENCE", lambda d: d["id"]),
        each(names, lambda e: F.length(e["value"]["replacement"]) > 256, "REPLACEMENT_TOO_LONG", lambda e: e["key"]),
        each(terms, lambda t: ~sized(t["value"]), "INVALID_EXACT_TERM", empty),
        repeated(terms, "DUPLICATE_EXACT_TERM", lambda t: t["value"]),
        each(allowed, lambda v: ~sized(v), "INVALID_ALLOWLIST_VALUE", empty),
        repeated(allowed, "DUPLICATE_ALLOWLIST_VALUE", lambda v: v),
        fail(mapping["reversible"] & blank(mapping["key_reference"]), "MISSING_KEY_REFERENCE"),
        fail(mapping["reversible"], "REVERSIBLE_MAPPING_NOT_IMPLEMENTED"),
        fail(mapping["scope"].isin("project", "global"), "PERSISTENT_MAPPING_NOT_IMPLEMENTED"),
        fail(F.col("image_mask.safety_margin_px") > 128, "IMAGE_MARGIN_TOO_LARGE"),
        fail(~fraction(F.col("image_mask.auto_apply_min_ocr_confidence")), "INVALID_IMAGE_OCR_CONFIDENCE"),
    ]
    checks = [F.coalesce(c, none) for c in checks]
    return policies.select(key, F.explode(F.concat(*checks)).alias("v")).select(key, "v.*")


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """One policy in each JSON file under path."""
    return spark.read.schema(POLICY_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def dimensions(spark: SparkSession, policy: Policy) -> dict[str, DataFrame]:
    """The policy as small tables, for joins with findings that come as rows."""
    return {
        "entity_policy": spark.createDataFrame([(k, e.enabled, e.auto_apply, e.replacement) for k, e in policy.entities.items()] or [], "entity_type string, enabled boolean, auto_apply boolean, policy_replacement string"),
        "detector_policy": spark.createDataFrame([(d.id, d.enabled, d.required, d.priority, d.min_confidence) for d in policy.detectors], "detector_id string, enabled boolean, required boolean, priority int, min_confidence float"),
        "exact_terms": spark.createDataFrame([*policy.exact_terms], "value string, entity_type string"),
        "allowlist": spark.createDataFrame([(v,) for v in policy.allowlist], "matched_text string"),
    }


def filter_findings(findings: Column, policy: Policy) -> Column:
    """Without values of the allowlist (as a whole) and without entities that are disabled or unknown to the policy."""
    enabled = [k for k, e in policy.entities.items() if e.enabled]
    keep = lambda f: f["entity_type"].isin(enabled) & (~f["matched_text"].isin(list(policy.allowlist)) if policy.allowlist else F.lit(True))
    return F.filter(findings, keep) if enabled else F.array().cast(f"array<{FINDING}>")


def apply_policy(findings: Column, policy: Policy) -> Column:
    """Replacement and selection as the policy has them; what is selected counts as reviewed."""
    texts = F.create_map(*[F.lit(x) for k, e in policy.entities.items() for x in (k, e.replacement)])
    auto = [k for k, e in policy.entities.items() if e.auto_apply]
    least = F.lit(policy.auto_apply_min_confidence).cast("float")

    def decide(f: Column) -> Column:
        selected = f["selected"] & (f["entity_type"].isin(auto) if auto else F.lit(False)) & (f["confidence"] >= least)
        return with_fields(f, replacement=F.element_at(texts, f["entity_type"]), selected=selected, reviewed=selected)

    return F.transform(filter_findings(findings, policy), decide)


def filter_finding_rows(findings: DataFrame, policy: Policy) -> DataFrame:
    """filter_findings for findings as rows: two joins with tables of the policy's size."""
    dims = dimensions(findings.sparkSession, policy)
    kept = findings.join(F.broadcast(dims["allowlist"]), "matched_text", "left_anti")
    return kept.join(F.broadcast(dims["entity_policy"].where("enabled").select("entity_type")), "entity_type", "left_semi").select(*findings.columns)


def apply_policy_rows(findings: DataFrame, policy: Policy) -> DataFrame:
    dims = dimensions(findings.sparkSession, policy)
    least = F.lit(policy.auto_apply_min_confidence).cast("float")
    joined = filter_finding_rows(findings, policy).join(F.broadcast(dims["entity_policy"]), "entity_type")
    selected = F.col("selected") & F.col("auto_apply") & (F.col("confidence") >= least)
    decided = joined.withColumn("selected", selected).withColumn("reviewed", F.col("selected")).withColumn("replacement", F.col("policy_replacement"))
    return decided.select(*findings.columns)


def detector_runtimes(spark: SparkSession, policy: Policy, runtimes: list[str]) -> DataFrame:
    """Enabled detectors by priority (ties as listed) with what happens to each: run, skip with a diagnostic, or fail."""
    rows = [(i, d.id, d.required, d.priority) for i, d in enumerate(policy.detectors) if d.enabled]
    wanted = spark.createDataFrame(rows, "place int, detector_id string, required boolean, priority int")
    have = spark.createDataFrame([(r,) for r in runtimes], "detector_id string").withColumn("configured", F.lit(True))
    joined = wanted.join(F.broadcast(have), "detector_id", "left").withColumn("configured", F.coalesce("configured", F.lit(False)))
    code = F.when(F.col("configured"), "RUN").when(F.col("required"), "REQUIRED_DETECTOR_UNAVAILABLE").otherwise("MODEL_RUNTIME_NOT_CONFIGURED")
    return joined.withColumn("outcome", code).orderBy(F.desc("priority"), "place")


def detector_order(spark: SparkSession, policy: Policy) -> DataFrame:
    """place, detector_id, priority: the order in which detectors run, highest priority first, else as the policy has them."""
    rows = [(i, d.id, d.priority) for i, d in enumerate(sorted(policy.detectors, key=lambda d: -d.priority))]  # a policy's few
    return spark.createDataFrame(rows, "place int, detector_id string, priority int")
