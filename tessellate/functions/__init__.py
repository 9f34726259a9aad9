"""tessellate.functions."""
