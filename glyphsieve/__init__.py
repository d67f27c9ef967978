"""Rule-based text analytics for PySpark."""
