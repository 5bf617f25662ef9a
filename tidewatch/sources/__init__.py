"""Readers and writers: files to tables of the schemas that operators expect."""
