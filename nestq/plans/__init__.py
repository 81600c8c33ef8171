"""Part of nestq."""
