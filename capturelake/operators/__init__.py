"""Table operators: gates, motion, selection, joins, points, exports and reports."""
