"""Sinks: workbooks, detail files, texts and documents."""
