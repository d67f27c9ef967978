"""Rules over streams: matching is a stateless map, counts are windowed aggregates."""

from glyphsieve.streaming.keyed import last_changes, rule_changes, rules_over_keys
from glyphsieve.streaming.matching import hit_counts, match_stream
from glyphsieve.streaming.sessions import session_hits
from glyphsieve.streaming.sinks import run_in_parts, run_to_files, scratch_folder

__all__ = ["hit_counts", "last_changes", "match_stream", "rule_changes", "rules_over_keys", "run_in_parts", "run_to_files", "scratch_folder", "session_hits"]
