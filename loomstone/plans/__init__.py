"""Named queries over the driver's tables, each a (spark, sf_dir) -> DataFrame callable, with their oracle SQL."""
