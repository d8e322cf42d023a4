"""The prose of evaluation sets: templates and questions, which the user gives as a file. The engine holds none of its own."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EvalProse:
    """templates, probes: intent -> texts with {drug} and, in templates, {entity}. out_of_scope: questions about no label.
    beyond_label: texts with {drug} that no label answers. names: names that may be absent, in the order they are tried;
    unknown: a text with {name}. aspects: (what is asked, section code) that labels may lack; missing: a text with {aspect}
    and {drug}. opening: a first turn with {drug}; follow_ups: (second turn that refers back, intent). scripts: name -> turns."""

    templates: dict[str, list[str]]
    probes: dict[str, list[str]]
    out_of_scope: list[str]
    beyond_label: list[str]
    names: list[str]
    unknown: str
    aspects: list[tuple[str, str]]
    missing: str
    opening: str
    follow_ups: list[tuple[str, str]]
    scripts: dict[str, list[str]]

    @property
    def frames(self) -> list[tuple[str, int, str]]:
        """intent, number, text of all templates in order."""
        return [(intent, n, t) for intent, group in self.templates.items() for n, t in enumerate(group)]


def read_prose(spark: SparkSession, path: str) -> EvalProse:
    """A JSON object with the fields of EvalProse, from wherever Spark reads."""
    held = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    absent = [f.name for f in fields(EvalProse) if f.name not in held]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    pairs = {n: [tuple(x) for x in held[n]] for n in ("aspects", "follow_ups")}
    return EvalProse(**{f.name: pairs.get(f.name, held[f.name]) for f in fields(EvalProse)})
