"""basketry: labelled baskets of free-text items, resolved, described, scored and searched with Spark."""
