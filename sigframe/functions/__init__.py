"""Part of sigframe."""
