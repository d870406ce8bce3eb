"""skeinworks: PySpark-native analytics for text-to-graph corpora."""
