from sproutscope.functions.scalars import *  # noqa: F401,F403
from sproutscope.functions.anchored import *  # noqa: F401,F403
