"""tessellate.plans."""
