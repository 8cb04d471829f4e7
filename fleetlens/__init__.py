"""fleetlens: operational analytics as PySpark DataFrame operators."""
