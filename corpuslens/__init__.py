"""corpuslens: analytics over document corpora as DataFrame -> DataFrame operators."""
