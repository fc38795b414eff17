"""Spark-native graph retrieval: documents become a bipartite graph of facts and entities that answers questions."""
