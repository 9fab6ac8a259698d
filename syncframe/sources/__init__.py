"""Sources: file trees, chunks of files, journals, documents and text protocols as DataFrames."""

from syncframe.sources.documents import *  # noqa: F403
from syncframe.sources.files import *  # noqa: F403
