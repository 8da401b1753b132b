"""graphloom: a Spark-native engine for querying and mining typed property graphs."""
