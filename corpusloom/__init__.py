"""corpusloom: a Spark-native engine for building, curating and evaluating text corpora."""
