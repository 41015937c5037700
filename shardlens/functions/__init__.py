"""Column-expression builders: text rules, rendering, field aliases."""
