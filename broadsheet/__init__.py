"""broadsheet: a PySpark-native engine for curating and querying streams of documents."""
