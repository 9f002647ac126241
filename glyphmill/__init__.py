"""glyphmill: content forensics over tables of documents, pages, vectors and events, on Spark."""
