"""lintlake: source-corpus quality analytics as Spark DataFrame jobs.

Everything is keyed by ``repo``; a single repository is a ``WHERE repo = ...``.
"""

__version__ = "1.0.0"
