"""Readers and writers of point-cloud and mesh files."""

from .reader import read_cloud, register

__all__ = ["read_cloud", "register"]
