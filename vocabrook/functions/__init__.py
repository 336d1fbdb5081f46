"""Part of vocabrook."""
