"""Print the query keys of the given catalog modules."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import catalog  # noqa: E402
from catalog.registry import REGISTRY  # noqa: E402

before = 0
for name in catalog.MODULES:
    __import__(f"catalog.{name}")
    keys = list(REGISTRY)[before:]
    before = len(REGISTRY)
    if name in sys.argv[1:]:
        print(" ".join(keys))
