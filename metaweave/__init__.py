"""metaweave: typed-network analytics and corpus operators on Spark."""
