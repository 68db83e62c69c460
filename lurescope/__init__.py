"""Web-threat analytics as set-oriented Spark plans over tables of URLs, pages and engine answers."""
