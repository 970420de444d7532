"""heronry: a Spark-native engine for community-activity analytics and text corpora."""
