"""Registered queries, their input views and their SQL."""
