"""papersluice: document triage and corpus preparation as Spark jobs."""
