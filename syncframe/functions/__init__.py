"""Column functions: no user-defined functions, so every expression stays in generated code."""

from syncframe.functions.bits import *  # noqa: F403
from syncframe.functions.grid import *  # noqa: F403
from syncframe.functions.names import *  # noqa: F403
from syncframe.functions.paths import *  # noqa: F403
