"""Dashboard panels as reports over samples."""
