"""graphmill: code-graph retrieval, event normalization and data preparation as Spark plans."""
