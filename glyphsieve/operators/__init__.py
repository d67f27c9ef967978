"""Operators over DataFrames: the rule engine and its builder, rules that change, joins by time, bitmaps of rules."""

from glyphsieve.operators.engine import RuleEngine, RuleEngineBuilder
from glyphsieve.operators.versions import RuleVersions

__all__ = ["RuleEngine", "RuleEngineBuilder", "RuleVersions"]
