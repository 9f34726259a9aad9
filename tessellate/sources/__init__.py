"""tessellate.sources."""
