"""The helpers of conftest under a name of their own, as the other tests have a conftest too."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
BASE, CLASHING, EDGE, docs_frame, prose = (getattr(_module, n) for n in ("BASE", "CLASHING", "EDGE", "docs_frame", "prose"))
DATA = "/root/testdata/sf0.001"
