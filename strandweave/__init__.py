"""Assembly-graph analytics and scaffolding expressed as Spark jobs."""
