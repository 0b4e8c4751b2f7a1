"""Code-audit analytics over tables of repository files, written as Spark jobs."""
