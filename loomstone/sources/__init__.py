"""Tables: the derived evidence spine, file sources and snapshot sinks."""
