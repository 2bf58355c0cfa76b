"""Part of basketry; see README.md."""
