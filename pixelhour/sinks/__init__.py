"""Writers. All of them write many part files in parallel; none gathers its output in one task."""
