from helixmill.sources.tables import materialise, partitions, shared_folder, spread, table

__all__ = ["materialise", "partitions", "shared_folder", "spread", "table"]
