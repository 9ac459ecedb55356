"""Plans: the pattern language, and the queries over the carrier tables."""
