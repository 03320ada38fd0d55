"""A Spark-first engine for semi-structured map features: serving, upkeep, spatial joins, hierarchies and trail graphs."""
