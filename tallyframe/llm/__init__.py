"""Training-data pipeline operators (numbered 1 to 10) and their registered queries."""
