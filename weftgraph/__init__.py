"""Graph analytics over relational tables, written as Spark DataFrame plans."""
