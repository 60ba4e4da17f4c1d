"""The engine's query catalogue."""

from . import core, files, images, linking, lists, scalars, streams, texts  # noqa: F401
from .catalogue import QUERIES, SQL  # noqa: F401
