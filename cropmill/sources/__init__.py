"""Readers and writers of datasets, records, shards and progress logs."""
