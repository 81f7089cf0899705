"""Named queries: one callable ``(spark, sf_dir) -> DataFrame`` each, with its oracle SQL."""
