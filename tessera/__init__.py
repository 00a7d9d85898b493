"""tessera: a PySpark-native engine for keyed-entity queries and data-structure analytics."""
