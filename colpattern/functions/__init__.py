"""Part of colpattern."""
