"""waymark: address-intelligence and corpus pipelines as Spark jobs."""
