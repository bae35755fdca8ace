"""Article and claim analytics as PySpark DataFrame operators."""
