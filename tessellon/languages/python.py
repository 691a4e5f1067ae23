"""Python."""

import re

from tessellon.languages.base import Language, python_names

_OPENS = re.compile(r"""(?:^|\n)(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*$""")


def _is_docstring(token: str, text: str, start: int) -> bool:
    """A triple-quoted string without a prefix that opens the module or follows a colon's line end."""
    if not token.startswith(('"""', "'''")):
        return False
    before = text[:start]
    lead = before.rstrip(" \t")
    if not lead.endswith("\n") and lead:
        return False
    code = re.sub(r"#[^\n]*", "", before).rstrip()
    return not code or code.endswith(":")


LANGUAGE = Language(
    name="python",
    extension=".py",
    comments=(r"#[^\n]*",),
    strings=(r'[rRbBuUfF]{0,2}"""(?:\\.|(?!""").)*?"""', r"[rRbBuUfF]{0,2}'''(?:\\.|(?!''').)*?'''", r'[rRbBuUfF]{0,2}"(?:\\.|[^"\\\n])*"', r"[rRbBuUfF]{0,2}'(?:\\.|[^'\\\n])*'"),
    is_safe=_is_docstring,
    structural=python_names(),
    type_first=False,
    # Expressions for boilerplate.
    candidates=(
        r"from\s+[\w.]+\s+import\s+[\w, ]+",
        r"import\s+[\w.]+(?:\s+as\s+\w+)?",
        r"@\w+(?:\.\w+)*(?:\([^)\n]*\))?",
        r"def\s+__\w+__\(self[^)\n]*\)(?:\s*->\s*[\w\[\], .]+)?:",
        r"def\s+\w+\(self[^)\n]{0,80}\)(?:\s*->\s*[\w\[\], .]+)?:",
        r"(?:Optional|List|Dict|Tuple|Union|Sequence|Iterable|Callable)\[[\w, .\[\]]+\]",
        r"raise\s+\w+(?:Error|Exception)\(",
        r"except\s+\(?[\w, .]+\)?(?:\s+as\s+\w+)?:",
        r"if\s+__name__\s*==\s*",
        r"super\(\)\.__init__\([^)\n]*\)",
        r"self\.\w+\s*=\s*\w+",
        r"log(?:ger|ging)\.(?:debug|info|warning|error|exception)\(",
        r"assert\s+\w+(?:\.\w+)*\s*(?:==|is|in|not)",
        r"self\.assert\w+\(",
        r"with\s+open\([^)\n]*\)\s+as\s+\w+:",
        r"for\s+\w+(?:,\s*\w+)?\s+in\s+(?:range|enumerate|zip|sorted)\(",
        r"\.(?:append|extend|items|keys|values|format|join|split|strip|get)\(",
        r"isinstance\(\w+,\s*[\w(), .]+\)",
        r"if\s+\w+(?:\.\w+)*\s+is\s+(?:not\s+)?None:?",
        r"return\s+(?:self\.\w+|None|True|False|\w+\([^)\n]{0,40}\))",
        r":(?:param|type|raises|returns?|rtype)[^:\n]*:",
        r"(?:Args|Returns|Raises|Yields|Examples|Parameters):",
        r"class\s+\w+\([\w., ]*\):",
        r"@pytest\.(?:mark\.\w+|fixture)(?:\([^)\n]*\))?",
        r"\w+:\s*(?:str|int|float|bool|bytes|list|dict)(?:\s*=\s*[^,)\n]+)?",
        r"->\s*(?:None|str|int|float|bool|Any)",
        r"async\s+def\s+\w+\(",
        r"await\s+\w+(?:\.\w+)*\(",
        r"np\.\w+\(",
        r"try:|finally:|else:",
    ),
    # Where a dictionary starts.
    seeds=tuple((p, c) for c, ps in {
        "import": ("import os", "import sys", "import re", "import json", "import logging", "from typing import ", "from dataclasses import dataclass", "from pathlib import Path", "from collections import defaultdict", "import numpy as np", "import pandas as pd", "from __future__ import annotations"),
        "dunder": ("def __init__(self", "def __repr__(self)", "def __str__(self)", "def __eq__(self, other)", "def __hash__(self)", "def __len__(self)", "def __iter__(self)", "def __getitem__(self, ", "def __setitem__(self, ", "def __enter__(self)", "def __exit__(self, ", "def __call__(self", "def __contains__(self, ", "def __next__(self)", "super().__init__("),
        "decorator": ("@property", "@staticmethod", "@classmethod", "@dataclass", "@abstractmethod", "@functools.wraps(", "@contextmanager", "@pytest.fixture", "@pytest.mark.parametrize("),
        "typehint": (" -> None:", " -> str:", " -> int:", " -> bool:", "Optional[str]", "Dict[str, Any]", "List[str]", ": str = ", ": int = "),
        "expression": ("raise NotImplementedError", "raise ValueError(", "raise TypeError(", "except Exception as e:", "except ImportError:", "except KeyError:", "if not isinstance(", "for i in range(", "return self._", "with open(", " is not None", " if __name__ == "),
        "logging": ("logger = logging.getLogger(__name__)", "logger.info(", "logger.debug(", "logger.warning(", "logger.error(", "logger.exception("),
        "docstring": ("Args:", "Returns:", "Raises:", ":param ", ":return: ", ":type ", "Parameters\n    ----------"),
        "test": ("self.assertEqual(", "self.assertTrue(", "self.assertFalse(", "self.assertIsNone(", "self.assertRaises(", "def setUp(self):", "def tearDown(self):", "unittest.TestCase"),
    }.items() for p in ps),
)
