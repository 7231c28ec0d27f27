"""Training-data preparation operators; ``tidewave.llm.registry`` lists their queries."""
