"""Readers and writers of sequence, alignment and annotation files."""
