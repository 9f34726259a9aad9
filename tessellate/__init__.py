"""tessellate: clustering and profiling of wide feature tables on Spark.

DataFrame -> DataFrame operators (``tessellate.operators``), column
functions (``tessellate.functions``), readers and writers
(``tessellate.sources``), composed jobs (``tessellate.plans``) and the
streaming form of the stateless scorers (``tessellate.streaming``).
"""

__version__ = "0.1.0"
