"""Planning aids: stored intermediate tables, size checks, skewed joins."""

from lociframe.plans.joins import sized_join, skew_join, within
from lociframe.plans.workspace import Workspace, remove_tables, scoped_tables

__all__ = ["Workspace", "remove_tables", "scoped_tables", "sized_join", "skew_join", "within"]
