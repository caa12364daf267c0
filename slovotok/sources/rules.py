"""Rule tables from files: a folder of YAML or JSON files, validated as a whole."""

from __future__ import annotations

import json
from pathlib import Path

from slovotok.plans.rules import DOMAINS, LEVELS, SEVERITIES, STATUSES, Rule

_KNOWN = {"id", "title", "domain", "level", "status", "severity", "source_refs", "requires", "tags", "detector", "examples", "suggestion", "explanation"}


class RuleFileError(ValueError):
    """A rule file that cannot be loaded, with its path."""


def _parsed(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as e:
        raise RuleFileError(f"{path}: reading YAML needs PyYAML") from e
    return yaml.safe_load(text) or {}


def _rule(raw: dict, path: Path) -> Rule:
    for key in ("id", "domain", "level", "status", "severity", "detector"):
        if not raw.get(key):
            raise RuleFileError(f"{path}: rule {raw.get('id', '?')}: {key} is missing")
    for key, allowed in (("domain", DOMAINS), ("level", LEVELS), ("status", STATUSES), ("severity", SEVERITIES)):
        if raw[key] not in allowed:
            raise RuleFileError(f"{path}: rule {raw['id']}: unknown {key} {raw[key]}")
    detector = dict(raw["detector"])
    kind, message = detector.pop("kind", None), detector.pop("message", None) or raw.get("title") or ""
    if not kind:
        raise RuleFileError(f"{path}: rule {raw['id']}: its detector has no kind")
    examples = raw.get("examples") or {}
    return Rule(
        raw["id"], kind, raw["domain"], raw["level"], raw["severity"], message, tuple(raw.get("requires") or ()), tuple(raw.get("tags") or ()), raw["status"], detector,
        raw.get("suggestion"), raw.get("explanation"), tuple(raw.get("source_refs") or ()), tuple(examples.get("valid") or ()), tuple(examples.get("invalid") or ()),
    )


def load_rules(folder: str) -> tuple[Rule, ...]:
    """The rules of all files below a folder, in the order of their paths. Fails on duplicate ids and on references to sources
    that no file states."""
    rules: dict[str, Rule] = {}
    sources: set[str] = set()
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml", ".json")):
        data = _parsed(path)
        sources |= {s["id"] for s in data.get("source_refs") or []}
        for raw in data.get("rules") or []:
            rule = _rule(raw, path)
            if rule.rule_id in rules:
                raise RuleFileError(f"{path}: duplicate rule id {rule.rule_id}")
            rules[rule.rule_id] = rule
    missing = {(r.rule_id, s) for r in rules.values() for s in r.source_refs if s not in sources}
    if missing:
        raise RuleFileError(f"unknown sources: {sorted(missing)[:5]}")
    return tuple(rules.values())
