"""Move tables, keep them in step, and analyse the runs that moved them - as Spark jobs."""
