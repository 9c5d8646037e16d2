"""tallyspark: test-run, trajectory and text-corpus analytics as Spark jobs."""
