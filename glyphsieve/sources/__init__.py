"""Where rules, texts and tables come from, and where results go."""

from glyphsieve.sources.datasource import register
from glyphsieve.sources.rules import from_dataframe, from_dict, from_json, lines, read_table, rules_from_json_column
from glyphsieve.tables import read_names

__all__ = ["from_dataframe", "from_dict", "from_json", "lines", "read_names", "read_table", "register", "rules_from_json_column"]
