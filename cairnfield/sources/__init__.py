"""Readers of map payloads and writers of layers."""
