"""Market-news analytics as Spark jobs: ingest, stories, assets, mood, read models, evaluation."""
