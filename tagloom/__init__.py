"""tagloom: prepare, decode and score sequence-labelling corpora as Spark jobs."""
