"""Verification of document revisions at corpus scale on Spark."""
