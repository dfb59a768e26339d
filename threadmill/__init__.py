"""threadmill: a PySpark-native engine for provenance graphs, retrieval and text corpora."""
