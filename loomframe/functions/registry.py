"""Named formulas and reconciliation rules: the built-in ones and those in TOML files of a user's folder (*.add).

A formula is a table with expression, description and category, and may have output_column and inputs. Reconciliation
rules stand in tables reconciliation (name), aliases (column: its other names) and groups (parent value: its parts).
A user's formula goes before a built-in one of the same name; files are read anew at each look-up.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from loomframe.errors import FormulaError, LoomError, need_columns
from loomframe.functions.catalog import CATALOG
from loomframe.functions.formulas import build, identifiers, parse, renamed

#: Names of verbs, which no formula may take.
RESERVED = frozenset({"to", "synthetic", "scan", "transform", "harmonize"})
_ALLOWED = re.compile(r"^[\w\s+\-*/%().,<>=!'\"`]+$")


@dataclass(frozen=True)
class Formula:
    name: str
    expression: str
    description: str = ""
    category: str = "user"
    output_column: str | None = None
    inputs: dict = field(default_factory=dict)

    def as_toml(self) -> str:
        quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = [f"[{self.name}]", *(f"{k} = {quoted(getattr(self, k))}" for k in ("expression", "description", "category"))]
        if self.output_column:
            lines.append(f"output_column = {quoted(self.output_column)}")
        if self.inputs:
            lines += ["", f"[{self.name}.inputs]"]
            for k, spec in self.inputs.items():
                lines.append(f"{k} = {{ " + ", ".join(f"{a} = {quoted(str(b))}" for a, b in spec.items()) + " }" if isinstance(spec, dict) else f"{k} = {quoted(str(spec))}")
        return "\n".join(lines) + "\n"


@dataclass(frozen=True)
class Reconciliation:
    name: str
    aliases: dict = field(default_factory=dict)
    groups: dict = field(default_factory=dict)


def read_formulas(text: str) -> tuple[dict[str, Formula], Reconciliation | None]:
    """Formulas and reconciliation rules of one TOML text."""
    try:
        tables = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise LoomError(f"not valid TOML: {e}") from e
    rules = None
    if "reconciliation" in tables:
        rules = Reconciliation(tables["reconciliation"].get("name", ""), tables.get("aliases", {}), tables.get("groups", {}))
        if not rules.name:
            raise LoomError("a reconciliation needs a name")
    out = {}
    for name, table in tables.items():
        if name in ("reconciliation", "aliases", "groups") and rules:
            continue
        if not isinstance(table, dict):
            raise LoomError(f"'{name}' is no table")
        if name in RESERVED:
            raise LoomError(f"'{name}' is the name of a verb", "Choose another")
        for key in ("sha", "requires"):
            if key in table:
                raise LoomError(f"formula '{name}': '{key}' isn't supported")
        for key in ("expression", "description", "category"):
            if not table.get(key):
                raise LoomError(f"formula '{name}' has no {key}")
        if not _ALLOWED.match(table["expression"]):
            raise LoomError(f"formula '{name}' has characters that aren't allowed")
        out[name] = Formula(name, table["expression"], table["description"], table["category"], table.get("output_column"), table.get("inputs", {}))
    return out, rules


BUILT_IN = {name: Formula(name, text, name.replace("_", " "), category) for category, own in CATALOG.items() for name, text in own.items()}


class Registry:
    """The formulas that can be called by name. folder: where the user's *.add files are; read on the driver only."""

    def __init__(self, folder: str | Path | None = None):
        self.folder = Path(folder) if folder else None

    def set_folder(self, folder: str | Path) -> str:
        if not Path(folder).is_dir():
            raise LoomError(f"no folder '{folder}'")
        self.folder = Path(folder)
        return str(self.folder)

    def _files(self):
        for path in sorted(self.folder.glob("*.add")) if self.folder else []:
            yield read_formulas(path.read_text(encoding="utf-8"))

    def formulas(self, source: str | None = None) -> dict[str, Formula]:
        """source: 'inbuilt', 'user' or both."""
        own = {k: v for f, _ in self._files() for k, v in f.items()} if source != "inbuilt" else {}
        return (BUILT_IN if source != "user" else {}) | own

    def find(self, name: str) -> Formula:
        source, _, bare = name.rpartition(":")
        found = self.formulas(source or None)
        need_columns(list(found), [bare], "formula")
        return found[bare]

    def reconciliation(self, name: str) -> Reconciliation:
        found = {r.name: r for _, r in self._files() if r}
        need_columns(list(found), [name], "reconciliation")
        return found[name]

    def apply(self, df: DataFrame, name: str, output: str | None = None, **columns: str) -> DataFrame:
        """df with a formula's column. columns: which column stands for which input; others go by name."""
        formula = self.find(name)
        tree = parse(formula.expression)
        inputs = identifiers(tree)
        unknown = [k for k in columns if k not in inputs]
        if unknown:
            raise LoomError(f"formula '{formula.name}' has no input '{unknown[0]}'", f"There are: {', '.join(inputs)}")
        missing = [i for i in inputs if columns.get(i, i) not in df.columns]
        if missing:
            raise FormulaError(f"formula '{formula.name}' needs '{missing[0]}'", 0, f"Name the column: {missing[0]}='...'")
        return df.withColumn(output or formula.output_column or formula.name, build(renamed(tree, columns), df.schema))

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        if name.startswith("_"):
            raise AttributeError(name)
        self.find(name)
        return lambda df, output=None, **columns: self.apply(df, name, output, **columns)
