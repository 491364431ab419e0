"""gridledger: a Spark-native analytics engine for grids, facts, documents and their text."""
