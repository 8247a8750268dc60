"""Search, recommendation and corpus analytics as PySpark DataFrame operators."""
