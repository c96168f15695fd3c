"""Column-to-column expressions; every one stays inside the JVM."""

from lariat.functions.text import fill_unknown, percent_label, remap, round_half_even, safe_key, strip, title_case

__all__ = ["fill_unknown", "percent_label", "remap", "round_half_even", "safe_key", "strip", "title_case"]
