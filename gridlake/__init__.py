"""gridlake: a PySpark engine for spreadsheet- and document-shaped data."""
