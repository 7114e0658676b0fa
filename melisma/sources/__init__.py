"""Readers: each returns a DataFrame with one row per item and the file's path."""

from .annotations import read_partitur, read_textgrid, read_tier_xml  # noqa: F401
from .audio import read_wav  # noqa: F401
from .tables import read_contour, read_key_values, read_labels, read_lines, read_pulses, recordings  # noqa: F401
