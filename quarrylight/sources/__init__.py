"""Table loaders, text and JSON readers, and file sinks."""
