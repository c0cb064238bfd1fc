"""tidemill: text retrieval, evaluation and corpus preparation as Spark DataFrame operators."""
