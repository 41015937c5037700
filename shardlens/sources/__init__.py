"""Sources (file discovery, readers, the Dataset) and sinks (export)."""
