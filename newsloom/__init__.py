"""newsloom: a Spark-native engine that turns an archive of Markdown pages into
news records and a typed knowledge graph, and answers queries over them."""

__version__ = "0.1.0"
