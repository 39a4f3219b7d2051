"""Sheet scans, year registries and report sinks."""
