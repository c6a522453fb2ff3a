"""Readers of binary archives: block streams, resource forks, firmware images, folders."""
