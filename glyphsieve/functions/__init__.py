"""The text transforms: of string columns, and of Python strings."""

from glyphsieve.functions.strings import process_text, reduce_text, reduce_text_emit
from glyphsieve.functions.transforms import reduce_text_process, reduce_text_process_emit, text_process, variants

__all__ = ["process_text", "reduce_text", "reduce_text_emit", "reduce_text_process", "reduce_text_process_emit", "text_process", "variants"]
