from sproutscope.sources.events import *  # noqa: F401,F403
from sproutscope.sources.tables import *  # noqa: F401,F403
