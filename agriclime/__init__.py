"""agriclime: crop-climate analytics as PySpark DataFrame operators."""
