"""tessellate.streaming."""
