"""Core queries over the test tables; each module registers its own."""

from lumenaudit.plans import files, images, metrics, similarity, skewed, tables  # noqa: F401
