"""Test modules of this folder share their plain versions."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
