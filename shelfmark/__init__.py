"""shelfmark: library-profile analytics as Spark DataFrame transformations."""
