"""corvane: a Spark-first engine for curating, searching and judging text at scale."""
