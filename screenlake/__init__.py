"""screenlake: screening a large text corpus with repeated, noisy scores, as Spark jobs."""
