"""veinstone: a PySpark-native engine for document-risk analytics."""
