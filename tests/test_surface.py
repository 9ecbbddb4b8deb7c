"""Every function the README's operator map names exists (documentation and code stay in step)."""

import importlib
import re
from pathlib import Path

README = Path(__file__).resolve().parent.parent / "README.md"


def test_operator_map_names_exist():
    text = README.read_text()
    section = text[text.index("## Operator map"):text.index("## Registered queries")]
    dotted = set(re.findall(r"`((?:sources|operators|functions|streaming|plans)\.[a-z_]+\.[a-z_]+)", section))
    assert dotted, "no references found"
    for ref in sorted(dotted):
        module, name = ref.rsplit(".", 1)
        assert hasattr(importlib.import_module(f"capindex.{module}"), name), ref
    import capindex
    bare = set(re.findall(r"`([a-z_]+)\(", section))
    missing = [n for n in sorted(bare) if not hasattr(capindex, n)]
    assert not missing, missing
