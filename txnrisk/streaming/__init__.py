"""The same features on a stream of new transactions."""
