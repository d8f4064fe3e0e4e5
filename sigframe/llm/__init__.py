"""Operators for preparing training corpora: splits, packing, mixing, personal information."""
