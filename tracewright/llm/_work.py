"""Tables between the steps of one operator, in the folder that all executors share."""

from ..sources.scratch import Work, shared_folder

__all__ = ["Work", "shared_folder"]
