"""graphloom: code-graph analytics and data preparation expressed as Spark DataFrame plans."""
