"""The same dataflow on streams."""
