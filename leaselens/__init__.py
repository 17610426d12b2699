"""leaselens: a PySpark-native engine for lease-contract documents."""
