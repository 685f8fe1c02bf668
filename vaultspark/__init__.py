"""vaultspark: a PySpark-native engine for collections of notes treated as data."""
