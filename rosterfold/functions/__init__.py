"""Column-level helpers: quoting and selection, null-safe numbers, labels."""
