"""tarn: retrieval, evidence scoring and evaluation as Spark DataFrame plans."""
