"""A small tree of modules, as (path, source)."""

ROWS = [
    ("pkg/engine.py", "class Motor:\n    pass\nclass Geared(Motor):\n    pass\n"),
    ("pkg/pumps.py", "from pkg.engine import Geared as Drive\nclass Pump(Drive):\n    pass\nclass PumpOf(Drive[str]):\n    pass\n"),
    ("pkg/fans.py", "import pkg.engine as works\nclass Fan(works.Motor):\n    pass\n"),
    ("pkg/mills.py", "class Mill(Motor):\n    pass\n"),
    ("pkg/handlers.py", "from abc import ABC\nclass Handler(ABC):\n    def run(self):\n        a = 1\n        b = a\n        return b\nclass AlphaHandler(Handler):\n    def _go(self, x):\n        y = x + 1\n        z = y * 2\n        return z\nclass BetaHandler(Handler):\n    def _went(self, q):\n        r = q + 5\n        s = r * 7\n        return s\nHANDLERS = {'alpha': AlphaHandler, 'beta': BetaHandler}\n"),
    ("pkg/env.py", "import os\nclass FeatureEnvironment:\n    def read(self):\n        return os.environ.get('A')\ndef elsewhere():\n    return os.getenv('B') == '1'\n"),
    ("pkg/broken.py", "def f(:\n"),
    ("pkg/spaced.py", "x = 1\n\n\n\n\n\n\ny = 2\nLIMIT = 7\n"),
    ("pkg/more.py", "LIMIT = 7\nREGISTRY = {}\nREGISTRY['a'] = Pump\nREGISTRY['b'] = Fan\ndef pick(kind):\n    if kind == 'a':\n        return 1\n    elif kind == 'b':\n        return 2\n    return hasattr(kind, 'x') or getattr(kind, 'y', None)\nALL = (AlphaHandler, BetaHandler)\n"),
    ("pkg/shapes.py", "from typing import Protocol\n__all__ = ['P', 'Box']\nclass P(Protocol):\n    pass\nclass Box:\n    left_x: int = 0\n    left_y: int = 0\n    left_z: int = 0\n    right_x: int = 0\n    right_y: int = 0\n    right_z: int = 0\n    @property\n    def kind(self):\n        return 'box'\n    @property\n    def a(self):\n        return self.left_x\n    @property\n    def b(self):\n        return self.left_y\n    @classmethod\n    def from_a(cls, v):\n        return cls()\n    @classmethod\n    def from_b(cls, v):\n        return cls()\n    @classmethod\n    def from_c(cls, v):\n        return cls()\n    def load_json(self, p):\n        return 1\n    def load_yaml(self, p):\n        return 2\n    def dump_json(self, p):\n        return 3\n    def dump_yaml(self, p):\n        return 4\n    def __getattr__(self, n):\n        return getattr(self, n)\nclass Bag:\n    @property\n    def kind(self):\n        return 'bag'\ndef wrap(a, b):\n    return inner(a, b)\ndef opt(a=None):\n    if a is None:\n        a = locals()\n    x = 1; y = 2\n    return make(a=a, x=x, y=y)\ndef first(v):\n    return isinstance(v, int) or isinstance(v, str)\ndef second(v):\n    return isinstance(v, (str, int))\n"),
    ("pkg/leaves.py", "class L1(Root):\n    a = 1\nclass L2(Root):\n    a = 2\nclass L3(Root):\n    a = 3\nclass M1(L1, L2):\n    pass\nclass M2(L1, L2):\n    pass\n"),
    ("pkg/empty.py", ""),
]
