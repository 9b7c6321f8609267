"""shelfmark: a Spark-native registry of datasets and their partition files.

Managers, datasets and partitions are Spark tables; bucket notifications are
folded into them by DataFrame transforms in batch or Structured Streaming.
"""

from .sources.registry import Registry, load_registry, commit_snapshot  # noqa: F401
