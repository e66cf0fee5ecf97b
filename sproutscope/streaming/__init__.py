from sproutscope.streaming.archive import *  # noqa: F401,F403
