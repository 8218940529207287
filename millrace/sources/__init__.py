from millrace.sources.tables import table, tables

__all__ = ["table", "tables"]
