"""Files and tables outside the session: exports, scans, stored copies."""
