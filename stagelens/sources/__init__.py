"""Readers and writers; every JSON read has an explicit schema."""
