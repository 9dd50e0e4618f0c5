"""Loomframe: key lookups, column transforms, profiling, comparison and synthesis of DataFrames on Spark."""

__version__ = "0.1.0"

from loomframe.errors import CardinalityError, FormulaError, LoomError
from loomframe.operators.lineage import Traced
from loomframe.operators.lookup import key_report, merge
from loomframe.plans.api import analyse, analyze, configure, formulas, scan, synthetic, to, transform

__all__ = ["CardinalityError", "FormulaError", "LoomError", "Traced", "analyse", "analyze", "configure", "formulas", "key_report", "merge", "scan", "synthetic", "to", "transform"]
