"""Estate analytics as Spark jobs: profiling, queries, audits, change sets and synthesis."""

__version__ = "0.1.0"
