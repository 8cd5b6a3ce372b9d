"""Part of cuegrid."""
