"""DataFrame -> DataFrame operators of the two analyses.

``labels`` / ``rates``: rate frequency. ``properties`` / ``geo`` / ``features`` /
``knn`` / ``compset``: competitive sets.
"""
