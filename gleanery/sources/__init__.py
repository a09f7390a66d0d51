"""JSON-lines sources and sinks, ordinals and resumption."""
