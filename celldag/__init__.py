"""celldag: integration of labelled, spreadsheet-shaped data as Spark plans, with cell-level lineage."""
