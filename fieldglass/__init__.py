"""fieldglass: posting analytics and corpus preparation as Spark jobs."""
