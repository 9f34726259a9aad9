"""tessellate.operators."""
