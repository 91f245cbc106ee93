"""Column-expression building blocks (pure pyspark.sql.functions, JVM-side)."""
