"""PySpark analytics over multi-timeframe market bars and scan snapshots."""
