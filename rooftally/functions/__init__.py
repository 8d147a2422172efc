"""Column-level building blocks: geometry, measures, WKB and simplification."""
