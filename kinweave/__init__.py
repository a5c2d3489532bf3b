"""kinweave: relational-event and social-network analytics as Spark DataFrame plans."""
