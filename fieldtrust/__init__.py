"""fieldtrust: multi-source field consensus, verification and evaluation as Spark jobs."""
