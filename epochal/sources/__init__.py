"""Reading and writing commit logs, base snapshots and reports."""
