"""Readers and writers: fact files, knowledge base folders and compressed bundles."""
