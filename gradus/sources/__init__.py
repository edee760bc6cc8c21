"""Readers with explicit schemas and contracts, image scans, and writers."""
