"""snaplake: nested JSON snapshots in, typed keyed tables and guarded queries out, all on Spark."""

__version__ = "0.1.0"
