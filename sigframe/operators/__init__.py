"""Relational and array operators over recordings, channels, signals and epochs."""
