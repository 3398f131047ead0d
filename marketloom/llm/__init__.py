"""Training-data operators over document tables. Nothing outside this folder imports it."""
