"""cairn: catalog, lineage and audit analytics as Spark DataFrame programs."""
