"""Project definitions: validation, chain order and signatures for reuse."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame

from celldag.functions.normalize import NormalizeError, validate_steps
from celldag.operators import signatures
from celldag.operators.dag import BLOCKS

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


class ProjectError(ValueError):
    """A project is not well formed."""


@dataclass
class Project:
    """fields: [{name, concept, type?, unit?}]; sources: exclude_documents and include_nodes; transform: [{op, config}]."""

    name: str
    fields: list[dict]
    sources: dict = field(default_factory=dict)
    transform: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Project:
        raw = yaml.safe_load(text) or {}
        project = cls(raw.get("name") or "", raw.get("fields") or [], raw.get("sources") or {}, raw.get("transform") or [])
        project.validate()
        return project

    def validate(self) -> None:
        """Names are identifiers, of fields once each; steps are known; include_nodes names fields."""
        for name in [self.name, *[f.get("name") for f in self.fields]]:
            if not isinstance(name, str) or not NAME.fullmatch(name):
                raise ProjectError(f"not a name: {name!r}")
        names = [f["name"] for f in self.fields]
        if not names or len(set(names)) != len(names):
            raise ProjectError("fields must be there, each name once")
        if unknown := set((self.sources.get("include_nodes") or {})) - set(names):
            raise ProjectError(f"include_nodes names no field: {sorted(unknown)}")
        for step in self.transform:
            if step.get("op") not in BLOCKS:
                raise ProjectError(f"unknown operator: {step.get('op')!r}")
            for rule in (step.get("config") or {}).get("rules") or [] if step["op"] == "value_normalize" else []:
                try:
                    validate_steps(rule.get("steps"))
                except NormalizeError as e:
                    raise ProjectError(str(e)) from e

    def field_units(self) -> dict[str, str]:
        return {f["name"]: f["unit"] for f in self.fields if f.get("unit")}

    def signature(self, current_payloads: list[str], units_version: str) -> str:
        """Equal for builds that must give the same result: config, sources, chain, payloads now current, unit rules."""
        parts = [self.name, self.fields, self.sources, self.transform, sorted(current_payloads), units_version]
        return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def data_signature(project: Project, kept: DataFrame, keys: list[str], units_version: str) -> str:
    """As `signature`, from the payloads' kept sums instead of a list of their names: one row comes to the driver, however many there are."""
    total = signatures.overall(kept, keys).first()
    return project.signature([f"{total['n']}:{total['signature']}"], units_version)


def reusable(project: Project, signature: str, builds: list[dict], newest: int = 25) -> dict | None:
    """The newest build (of the last `newest`) of the same signature whose artifact is still there; only for chosen nodes."""
    if not project.sources.get("include_nodes"):
        return None
    recent = sorted(builds, key=lambda b: b["finished_at"], reverse=True)[:newest]
    return next((b for b in recent if b["signature"] == signature and b.get("artifact_exists", True)), None)


def chain(nodes: dict[str, dict], edges: list[tuple[str, str]]) -> list[dict]:
    """Steps in order from a linear chain's edges: one head, all reached, none twice."""
    after = dict(edges)
    heads = set(nodes) - {b for _, b in edges}
    if len(after) != len(edges) or len({b for _, b in edges}) != len(edges) or (nodes and len(heads) != 1):
        raise ProjectError("the steps are no single chain")
    at, out = next(iter(heads), None), []
    while at is not None:
        out.append(nodes[at])
        at = after.get(at)
    if len(out) != len(nodes):
        raise ProjectError("some steps are not reached")
    return out
