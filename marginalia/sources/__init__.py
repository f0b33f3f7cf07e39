"""Vault files, remote tables and configuration."""
