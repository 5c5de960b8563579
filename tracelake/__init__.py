"""tracelake: Spark jobs over the execution journals of AI workflow systems."""
