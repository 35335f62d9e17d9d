"""Entity behaviour analytics on PySpark: find anomalous actors in large event logs."""
