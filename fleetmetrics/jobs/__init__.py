"""Snapshot jobs: wide snapshot tables of a whole fleet in, wide metric rows out.

Every job groups by (host, snapshot_ts), so it runs over any stretch of snapshot history of any
number of hosts; "now" is always the snapshot time.  ``catalog`` names the metrics and melts them.
"""
