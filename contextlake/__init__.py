"""contextlake: context selection over tables of files, written as Spark DataFrame jobs."""
