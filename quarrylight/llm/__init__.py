"""Operators for large text corpora: cleaning, linking, deduplicating, mixing."""

import sys

from quarrylight import runtime

runtime.ship(sys.modules["quarrylight"])
