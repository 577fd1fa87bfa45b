"""feedlake: turns large collections of links and stored pages into feeds, on Spark."""
