"""Streams: windows with watermarks, duplicates, joins, state of one's own; and queues, topics and change feeds as stored tables."""
