"""Part of the quarrydeck analytics engine."""
