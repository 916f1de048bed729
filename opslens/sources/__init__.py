"""Readers, sinks and the table views the registered queries run over."""
